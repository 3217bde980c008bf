"""The engine's entities over the tables of a folder, each as a DataFrame and as the CTE of the
statements that check it.

Captures and generation judgements are tables of their own; judged retrievals, judge calls and
requests of two runs are derived from the order tables, which have natural gaps, ties and repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import global_row_number
from .registry import table

LABEL_SQL = "regexp_replace(lower(trim(label)), '[ _-]+', '_', 'g')"

#: White space as Unicode has it, in DuckDB's regular expressions.
WHITE_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

CTE = {
    "cap": "cap as (select * exclude (rn) from (select *, row_number() over (partition by request_id order by stored_at desc) as rn from request_captures where request_id is not null) where rn = 1)",
    "gen": f"gen as (select * exclude (rn, label), {LABEL_SQL} as label from (select *, row_number() over (partition by request_id, run_id, suite_name order by created_at desc) as rn from judge_generation_results) where rn = 1)",
    "req": "req as (select o_orderkey as request_id, o_orderdate as received_at, o_orderpriority as run_id, case o_orderstatus when 'F' then 'Dense' when 'O' then 'Hybrid' else 'Sparse' end as retriever_kind, o_custkey as question_id, o_totalprice as price from orders)",
    "ret": """ret as (select l_orderkey as request_id, l_partkey as chunk_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as int) as rank,
      case l_returnflag when 'R' then 1.0 when 'A' then 0.5 else 0.0 end::double as score, case l_returnflag when 'R' then 'relevant' when 'A' then 'partial' else 'irrelevant' end as label,
      l_discount::double as retrieval_score, l_suppkey as document_id from lineitem)""",
    "calls": "calls as (select l_orderkey as request_id, case l_linestatus when 'O' then 'judge_generation' else 'judge_retrieval' end as stage, cast(l_quantity as bigint) as prompt_tokens, cast(l_linenumber as bigint) as completion_tokens from lineitem)",
    "doc": "doc as (select doc_id, text, lower(lang) as lang, lower(trim(source)) as source from documents where doc_id is not null and text is not null)",
    "chk": "chk as (select * exclude (rn) from (select *, row_number() over (partition by chunk_id order by ingest.ingested_at desc nulls last) as rn from chunks where chunk_id is not null) where rn = 1)",
}


def sql(*names: str, body: str) -> str:
    """A statement with the CTEs it needs."""
    body = body.strip()
    rest = body[5:] if body[:5].lower() == "with " else None
    parts = [CTE[n] for n in names]
    return "with " + ",\n".join(parts) + (",\n" + rest if rest else "\n" + body)


def _newest(df: DataFrame, keys: list[str], by) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(by)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """One row a request: its latest delivery."""
    return _newest(table(spark, folder, "request_captures").where("request_id is not null"), ["request_id"], F.desc("stored_at"))


def generation_results(spark: SparkSession, folder: str) -> DataFrame:
    """One row a request, run and suite, with the label in one spelling."""
    rows = _newest(table(spark, folder, "judge_generation_results"), ["request_id", "run_id", "suite_name"], F.desc("created_at"))
    return rows.withColumn("label", F.regexp_replace(F.lower(F.trim("label")), "[ _-]+", "_"))


def requests(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "Dense").when(F.col("o_orderstatus") == "O", "Hybrid").otherwise("Sparse")
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").alias("received_at"), F.col("o_orderpriority").alias("run_id"), kind.alias("retriever_kind"), F.col("o_custkey").alias("question_id"), F.col("o_totalprice").alias("price"))


def retrieval_results(spark: SparkSession, folder: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    flag = F.col("l_returnflag")
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("request_id"), F.col("l_partkey").alias("chunk_id"), F.row_number().over(order).alias("rank"),
        F.when(flag == "R", 1.0).when(flag == "A", 0.5).otherwise(0.0).alias("score"), F.when(flag == "R", "relevant").when(flag == "A", "partial").otherwise("irrelevant").alias("label"),
        F.col("l_discount").alias("retrieval_score"), F.col("l_suppkey").alias("document_id"),
    )


def judge_calls(spark: SparkSession, folder: str) -> DataFrame:
    stage = F.when(F.col("l_linestatus") == "O", "judge_generation").otherwise("judge_retrieval")
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("request_id"), stage.alias("stage"), F.col("l_quantity").cast("bigint").alias("prompt_tokens"), F.col("l_linenumber").cast("bigint").alias("completion_tokens"))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("doc_id is not null and text is not null").select("doc_id", "text", F.lower("lang").alias("lang"), F.lower(F.trim("source")).alias("source"))


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return _newest(table(spark, folder, "chunks").where("chunk_id is not null"), ["chunk_id"], F.desc_nulls_last("ingest.ingested_at"))


def rerank_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Every request with eight chunks: query_id, query, item_id, body, head, score, rank.

    Chunks are taken in eights by their position, requests go round over the eights.
    """
    texts = chunks(spark, folder).select("chunk_id", "text", "document_title", "section_title")
    asked = captures(spark, folder).where("raw_query is not null").select("request_id", "raw_query")
    c = global_row_number(texts.select("chunk_id"), ["chunk_id"], "n")
    q = global_row_number(asked.select("request_id"), ["request_id"], "n")
    eights = c.agg(F.ceil(F.count("*") / 8).alias("eights"))
    head = F.concat_ws(" ", F.coalesce("document_title", F.lit("")), F.coalesce("section_title", F.lit("")))
    c = texts.join(c, "chunk_id").select(F.col("chunk_id").alias("item_id"), F.col("text").alias("body"), head.alias("head"), (F.col("n") % 97 / 97.0).alias("score"), F.col("n").alias("rank"), F.floor(F.col("n") / 8).alias("grp"))
    q = asked.join(q, "request_id").join(F.broadcast(eights)).select((F.col("n") % F.col("eights")).alias("grp"), F.col("request_id").alias("query_id"), F.col("raw_query").alias("query"))
    return q.join(c, "grp")
