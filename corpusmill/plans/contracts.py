"""Writers with contracts, configuration checks, retrievers and rerankers behind one interface."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import config as C
from ..operators import rerank as R
from ..operators import services as SV
from ..operators import upsert as U
from ..operators import validate as VA
from ..session import shared_folder
from ..sources import readers, writers
from . import retrieval as RP
from .documents import collapsed
from .entities import captures, chunks, generation_results, retrieval_results, sql
from .registry import Registry, table

REGISTRY = Registry()
Q = REGISTRY.query


def _fresh(spark, name):
    return f"{shared_folder(spark)}/corpusmill/{name}-{uuid.uuid4().hex}"


# keyed writes on their own tables ---------------------------------------------------------------------

KEYS = ["request_id", "run_id", "suite_name"]


@Q("snk07_insert_capture", sql("cap", body="select request_id, retriever_kind from cap"))
def snk07(spark, folder):
    """The captures with a run are there; those without come in.  A key twice would be an error."""
    rows = captures(spark, folder).select("request_id", "retriever_kind", "runtime_run_id")
    return U.insert_or_fail(rows.where("runtime_run_id is not null"), rows.where("runtime_run_id is null"), ["request_id"]).select("request_id", "retriever_kind")


@Q("snk08_insert_generation_judgement", "select request_id, run_id, suite_name, epoch_us(min(created_at)) as created from judge_generation_results group by 1, 2, 3")
def snk08(spark, folder):
    """First deliveries are there; repeated ones come in and are ignored."""
    rows = table(spark, folder, "judge_generation_results").select(*KEYS, "created_at")
    first = rows.withColumn("turn", F.row_number().over(Window.partitionBy(*KEYS).orderBy("created_at"))).where("turn = 1").drop("turn")
    return U.insert_ignore(first, rows, KEYS).select(*KEYS, F.unix_micros("created_at").alias("created"))


@Q("snk09_insert_retrieval_judgement", sql("ret", body="select request_id, chunk_id from ret where rank <= 3 union all select * from (select distinct request_id, chunk_id from ret where rank > 3 except select request_id, chunk_id from ret where rank <= 3)"))
def snk09(spark, folder):
    rows = retrieval_results(spark, folder).select("request_id", "chunk_id", "rank")
    return U.insert_ignore(rows.where("rank <= 3").drop("rank"), rows.where("rank > 3").drop("rank"), ["request_id", "chunk_id"])


@Q("snk13_upsert_run_config", "select run_id, max_by(judge_model || '/' || judge_prompt_version, (created_at, judge_model || '/' || judge_prompt_version)) as config from judge_generation_results where run_id is not null group by 1")
def snk13(spark, folder):
    """The configuration of each judge run, as its last row has it."""
    rows = table(spark, folder, "judge_generation_results").where("run_id is not null").select("run_id", F.concat("judge_model", F.lit("/"), "judge_prompt_version").alias("config"), "created_at")
    late = F.struct("created_at", "config")
    old = rows.groupBy("run_id").agg(F.min_by("config", late).alias("config"), F.min(late).alias("at"))
    new = rows.groupBy("run_id").agg(F.max_by("config", late).alias("config"), F.max(late).alias("at"))
    return U.upsert(old, new, ["run_id"], "at").select("run_id", "config")


@Q("snk23_upsert_runtime_config", "select runtime_run_id, max_by(pipeline_config_version || '/' || corpus_version, (received_at, pipeline_config_version || '/' || corpus_version)) as config from request_captures where runtime_run_id is not null group by 1")
def snk23(spark, folder):
    rows = table(spark, folder, "request_captures").where("runtime_run_id is not null").select("runtime_run_id", F.concat("pipeline_config_version", F.lit("/"), "corpus_version").alias("config"), "received_at")
    late = F.struct("received_at", "config")
    old = rows.groupBy("runtime_run_id").agg(F.min_by("config", late).alias("config"), F.min(late).alias("at"))
    new = rows.groupBy("runtime_run_id").agg(F.max_by("config", late).alias("config"), F.max(late).alias("at"))
    return U.upsert(old, new, ["runtime_run_id"], "at").select("runtime_run_id", "config")


def _refuse_discounts(points: list[dict]) -> None:
    """A stand-in for a vector store that refuses some points."""
    if any(p["l_discount"] > 0.095 for p in points):
        raise ValueError("refused")


@Q("snk04_write_in_batches", "select l_orderkey * 10 + l_linenumber as point, case when max(l_discount) > 0.095 then 'refused' end as error from lineitem group by 1")
def snk04(spark, folder):
    """Points in batches; a refused batch is written point by point."""
    points = table(spark, folder, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point")).agg(F.max("l_discount").alias("l_discount"))
    return SV.write_points(points, "point", ["l_discount"], _refuse_discounts, 32)


@Q("snk06_create_collection", "select true as created, false as again, 3 as fields, 0 as points")
def snk06(spark, folder):
    path = _fresh(spark, "collection")
    schema, properties = "chunk_id string, dense array<float>, sparse map<int, float>", {"distance": "cosine", "dimension": 64}
    made = [writers.create_collection(spark, path, schema, properties) for _ in range(2)]
    points = spark.read.parquet(f"{path}/points")
    return points.agg(F.count("*").cast("int").alias("points")).select(F.lit(made[0]).alias("created"), F.lit(made[1]).alias("again"), F.lit(len(points.columns)).alias("fields"), "points")


@Q("snk03_skipped_chunks_log", sql("chk", body="select chunk_id, 'ingest' as stage, 'fingerprint_changed' as error from chk where chunk_index % 4 <> 1 and chunk_index % 5 = 0"))
def snk03(spark, folder):
    """The chunks whose fingerprint changed, as the log of an ingest has them."""
    from .. import schemas
    from .ingest import _cdc

    actions = U.classify_changes(*_cdc(spark, folder), "chunk_id").where("action = 'skip_and_log'")
    path = _fresh(spark, "skipped")
    log = actions.join(chunks(spark, folder).select("chunk_id", "chunk_index"), "chunk_id").select("chunk_id", "chunk_index", F.lit("ingest").alias("stage"), F.lit("fingerprint_changed").alias("error"))
    writers.append_rejects(log, path)
    return readers.split_corrupt(readers.json_lines(spark, path, schemas.REJECT))[0].select("chunk_id", "stage", "error")


@Q("stm08_second_ingest", sql("chk", body="select case when chunk_index % 4 <> 1 and chunk_index % 5 = 0 then 'skip_and_log' else 'skip' end as action, count(*) as n from chk group by 1"))
def stm08(spark, folder):
    """The same rows ingested twice: the second time nothing is inserted or updated."""
    from .ingest import _cdc

    old, new = _cdc(spark, folder)
    state, _ = U.apply_changes(old, new, "chunk_id")
    return U.apply_changes(state, new, "chunk_id")[1].groupBy("action").agg(F.count("*").alias("n"))


@Q("snk14_run_manifest", "select distinct o_orderpriority as run_id, 'completed' as status from orders")
def snk14(spark, folder):
    """A manifest for each run, written, and found by the scan of the run folders; a broken one isn't."""
    path = _fresh(spark, "runs")
    for row in table(spark, folder, "orders").select("o_orderpriority").distinct().collect():  # five priorities
        writers.manifest(spark, f"{path}/{row[0]}/run_manifest.json", {"run_id": row[0], "status": "completed", "started_at": "2026-01-01T00:00:00Z"})
    writers.write_text(spark, f"{path}/broken/run_manifest.json", '{"run_id": ')
    return readers.run_manifests(spark, path).select("run_id", "status")


@Q("src13_run_folders", "select distinct o_orderpriority as run_id, true as in_folder from orders")
def src13(spark, folder):
    path = _fresh(spark, "runs")
    for row in table(spark, folder, "orders").select("o_orderpriority").distinct().collect():  # five priorities
        writers.manifest(spark, f"{path}/{row[0].replace(' ', '_')}/run_manifest.json", {"run_id": row[0], "status": "failed", "started_at": "soon"})
    return readers.run_manifests(spark, path).select("run_id", F.col("path").contains(F.replace("run_id", F.lit(" "), F.lit("_"))).alias("in_folder"))


@Q("snk16_report_text", sql("gen", body="select '# Run' || chr(10) || chr(10) || '## Suites' || chr(10) || chr(10) || '| suite_name | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || suite_name || ' | ' || n || ' |', chr(10) order by suite_name) || chr(10) as report from (select suite_name, count(*) as n from gen group by 1)"))
def snk16(spark, folder):
    """The report of all judged suites as Markdown; a section without rows is left out."""
    suites = generation_results(spark, folder).groupBy("suite_name").agg(F.count("*").alias("n")).orderBy("suite_name")
    text = writers.run_report("Run", {"Suites": suites, "Failures": suites.where("n < 0")})
    return spark.createDataFrame([(text,)], "report string")


# readers ----------------------------------------------------------------------------------------------


@Q("src06_chunk_positions", sql("chk", body="select chunk_id, row_number() over (order by chunk_id) - 1 as position from chk"))
def src06(spark, folder):
    """Chunks of one file with their position among its lines that aren't blank."""
    path = _fresh(spark, "lines")
    chunks(spark, folder).select("chunk_id", "doc_id").orderBy("chunk_id").coalesce(1).write.json(path)
    rows = readers.positioned(readers.json_lines(spark, path, "chunk_id string, doc_id string"))
    return rows.select("chunk_id", "position")


@Q("src09_golden_targets", "select r_name as question, 'n' || n_nationkey as item_id, n_nationkey / 100.0 as grade, true as is_soft, n_nationkey % 2 = 0 as is_strict from region join nation on n_regionkey = r_regionkey")
def src09(spark, folder):
    """Golden targets of a companion document: a question a region, its nations as items."""
    item = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    rows = table(spark, folder, "region").join(table(spark, folder, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(
        F.collect_list(item).alias("soft_positive_chunk_ids"), F.collect_list(F.when(F.col("n_nationkey") % 2 == 0, item)).alias("strict_positive_chunk_ids"), F.collect_list(F.struct(item.alias("chunk_id"), (F.col("n_nationkey") / 100).alias("score"))).alias("graded_relevance")
    )
    questions = rows.select(F.struct(F.col("r_name").alias("question_id"), F.col("r_name").alias("question"), "soft_positive_chunk_ids", "strict_positive_chunk_ids", "graded_relevance").alias("q"))
    path = _fresh(spark, "golden")
    questions.agg(F.collect_list("q").alias("questions")).select(F.lit("1").alias("version"), F.lit("s").alias("scenario"), "questions").coalesce(1).write.json(path)  # five regions
    return readers.golden_targets(spark, path).select("question", "item_id", F.round("grade", 6).alias("grade"), "is_soft", "is_strict")


@Q("src11_question_tags", "select n_name as question_id, unnest([r_name, 'all']) as tag from nation join region on n_regionkey = r_regionkey")
def src11(spark, folder):
    path = _fresh(spark, "tags")
    nations = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    tagged = F.struct(F.col("n_name").alias("question_id"), F.array("r_name", F.lit("all")).alias("tags"))
    nations.agg(F.to_json(F.collect_list(tagged)).alias("value")).write.text(path)  # 25 nations in one document
    return readers.question_tags(spark, path, nations.select(F.col("n_name").alias("question_id")))


# configuration ----------------------------------------------------------------------------------------


@Q("prj16_limit_clamp", "select l_orderkey, l_linenumber, least((l_quantity * 10)::int - 20, 200) as limit_ from lineitem where (l_quantity * 10)::int - 20 >= 1 union all select l_orderkey, l_linenumber, null from lineitem where (l_quantity * 10)::int - 20 < 1")
def prj16(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", C.clamped((F.col("l_quantity") * 10).cast("int") - 20, 200).alias("limit_"))


@Q("prj18_collection_name", "select collection_name, created_at, case when collection_name not like '%\\_bow' escape '\\' and collection_name not like '%\\_bm25' escape '\\' then collection_name || case sparse_strategy.kind when 'bag_of_words' then '_bow' when 'bm25_like' then '_bm25' end end as derived from bm25_term_stats")
def prj18(spark, folder):
    return table(spark, folder, "bm25_term_stats").select("collection_name", "created_at", C.derived_collection(F.col("collection_name"), F.col("sparse_strategy.kind")).alias("derived"))


@Q("val05_exact_objects", "select l_orderkey as request_id, bool_and(l_returnflag <> 'N' and l_linenumber <> 7) as valid from lineitem group by 1")
def val05(spark, folder):
    """Retrieved items as JSON: some scores are text, some items have a key too many."""
    score = F.when(F.col("l_returnflag") == "N", F.concat(F.lit('"'), F.col("l_discount").cast("string"), F.lit('"'))).otherwise(F.col("l_discount").cast("string"))
    extra = F.when(F.col("l_linenumber") == 7, ',"note":null').otherwise("")
    item = F.concat(F.lit('{"chunk_id":"'), F.col("l_partkey").cast("string"), F.lit('","score":'), score, extra, F.lit("}"))
    rows = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("request_id")).agg(F.collect_list(item).alias("items"))
    text = F.concat(F.lit("["), F.array_join("items", ","), F.lit("]"))
    return rows.select("request_id", VA.exact_objects(text, {"chunk_id": "text", "score": "number"}).alias("valid"))


@Q("val14_chunker_configs", "select chunking_version, list_filter([case when not coalesce(target_tokens >= 1, false) then 'target_tokens' end, case when not coalesce(overlap_ratio >= 0 and overlap_ratio < 0.2, false) then 'overlap_ratio' end, case when length(trim(chunking_version)) = 0 then 'chunking_version' end], lambda x: x is not null) as problems from chunker_config")
def val14(spark, folder):
    """Configurations against their bounds, here with overlaps below a fifth."""
    return table(spark, folder, "chunker_config").select("chunking_version", VA.violations(C.chunker_rules(overlap_below=0.2)).alias("problems"))


@Q("val20_weight_checks", "select p_partkey, list_sort(list_filter([case when not (p_retailprice - 1000 >= 0) then 'price' end, case when not (p_size >= 0) then 'size' end], lambda x: x is not null)) as problems from part")
def val20(spark, folder):
    weights = F.create_map(F.lit("price"), F.col("p_retailprice") - 1000, F.lit("size"), F.col("p_size").cast("double"))
    return table(spark, folder, "part").select("p_partkey", F.array_sort(C.bad_weights(weights)).alias("problems"))


@Q("mth08_smoothing", "select s_suppkey, case s_suppkey % 3 when 1 then 0.25::double when 2 then (s_suppkey % 7 / 10.0)::double end as floor_ from supplier")
def mth08(spark, folder):
    k = F.col("s_suppkey")
    text = F.when(k % 3 == 0, "standard").when(k % 3 == 1, "epsilon").otherwise(F.concat(F.lit("epsilon:0."), (k % 7).cast("string")))
    return table(spark, folder, "supplier").select("s_suppkey", C.smoothing_floor(text).alias("floor_"))


@Q("str04_single_line", sql("doc", body=f"select doc_id, length({collapsed('text')}) as letters, contains({collapsed('text')}, chr(10)) as breaks from doc"))
def str04(spark, folder):
    line = T.collapse(F.col("text"))
    return table(spark, folder, "documents").where("doc_id is not null and text is not null").select("doc_id", F.length(line).alias("letters"), line.contains("\n").alias("breaks"))


@Q("doc07_column_text", "select l_orderkey as page, string_agg('w' || l_partkey, ' ' order by (l_extendedprice >= 40000), l_linenumber, l_extendedprice, l_suppkey, l_partkey) as text from lineitem group by 1")
def doc07(spark, folder):
    """Words of a page as two columns: the left one's lines, then the right one's."""
    word = F.struct((F.col("l_extendedprice") >= 40000).alias("side"), F.col("l_linenumber").alias("top"), F.col("l_extendedprice").alias("x0"), "l_suppkey", "l_partkey")
    pages = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.array_sort(F.collect_list(word)).alias("w"))
    return pages.select("page", F.array_join(F.transform("w", lambda x: F.concat(F.lit("w"), x["l_partkey"].cast("string"))), " ").alias("text"))


# retrievers and rerankers behind one interface --------------------------------------------------------


@Q("udf01_retrievers", f"select 'dense' as kind, query_id, item_id, rank from ({RP.REGISTRY.sql['top01_dense_topk']}) union all select 'hybrid', query_id, item_id, rank from ({RP.REGISTRY.sql['top02_hybrid_threshold']})")
def udf01(spark, folder):
    found = {kind: RP.REGISTRY.queries[name](spark, folder).select(F.lit(kind).alias("kind"), "query_id", "item_id", "rank") for kind, name in (("dense", "top01_dense_topk"), ("hybrid", "top02_hybrid_threshold"))}
    return found["dense"].unionByName(found["hybrid"])


@Q("udf02_rerankers", sql("ret", body="select 'pass_through' as kind, request_id, rank as original, rank from ret union all select 'scored', request_id, rank, cast(row_number() over (partition by request_id order by score desc, rank) as int) from ret"))
def udf02(spark, folder):
    rows = retrieval_results(spark, folder).select("request_id", F.col("rank").alias("original"), "rank", "score")

    def by_score(candidates):
        best = Window.partitionBy("request_id").orderBy(F.desc("score"), "original")
        return candidates.withColumn("rank", F.row_number().over(best))

    rerankers: dict[str, SV.Reranker] = {"pass_through": SV.pass_through, "scored": by_score}
    out = [f(rows).select(F.lit(kind).alias("kind"), "request_id", "original", "rank") for kind, f in rerankers.items()]
    return out[0].unionByName(out[1])


@Q("snk19_point_ids", sql("chk", body="with h as (select chunk_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(chunk_id)) as h from chk) select chunk_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][(position(h[17] in '0123456789abcdef') - 1) % 4 + 1] || h[18:20] || '-' || h[21:32] as point_id from h"))
def snk19(spark, folder):
    return chunks(spark, folder).select("chunk_id", U.uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.col("chunk_id")).alias("point_id"))
