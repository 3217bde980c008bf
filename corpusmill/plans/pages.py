"""Sources and sinks as round trips through the shared folder, page geometry, remaining checks."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import BLANKS

from .. import schemas
from ..functions import jsonfix
from ..functions import text as T
from ..operators import cleanup as CL
from ..operators import rerank as R
from ..operators import services as SV
from ..operators import upsert as U
from ..operators import validate as VA
from ..session import shared_folder
from ..sources import readers, writers
from .documents import collapsed
from .entities import captures, chunks, generation_results, requests, rerank_candidates, retrieval_results, sql, texts
from .registry import Registry, table

REGISTRY = Registry()
Q = REGISTRY.query


def r(c, digits=6):
    return F.round(c, digits)


def _fresh(spark, name):
    return f"{shared_folder(spark)}/corpusmill/{name}-{uuid.uuid4().hex}"


# sources and sinks --------------------------------------------------------------------------------


@Q("src03_pages_jsonl", sql("chk", body="select doc_id, cast(chunk_index as int) as page, length(text) as n from chk where text is not null"))
def src03(spark, folder):
    p = _fresh(spark, "pages")
    writers.json_lines(chunks(spark, folder).where("text is not null").select("doc_id", F.col("chunk_index").cast("int").alias("page"), F.lit(None).cast("string").alias("raw_text"), F.col("text").alias("clean_text")), p)
    return readers.pages(spark, p).select("doc_id", "page", F.length("clean_text").alias("n"))


@Q("src04_pages_lenient", sql("chk", body=f"select doc_id, cast(chunk_index as int) as page, length({collapsed('text')}) as n from chk where text is not null"))
def src04(spark, folder):
    p = _fresh(spark, "pages")
    writers.json_lines(chunks(spark, folder).where("text is not null").select("doc_id", F.col("chunk_index").cast("int").alias("page"), F.col("text").alias("clean_text")), p)
    return readers.pages(spark, p, lenient=True).select("doc_id", "page", F.length("clean_text").alias("n"))


def _chunk_lines(spark, folder):
    p = _fresh(spark, "chunks")
    writers.json_lines(chunks(spark, folder), p)
    return p


@Q("src05_chunks_jsonl", sql("chk", body="select chunk_id, doc_id, len(section_path) as depth, ingest.embedding_model as model from chk"))
def src05(spark, folder):
    rows, _ = readers.split_corrupt(readers.json_lines(spark, _chunk_lines(spark, folder), schemas.CHUNK))
    return rows.select("chunk_id", "doc_id", F.when(F.col("section_path").isNotNull(), F.size("section_path")).cast("bigint").alias("depth"), F.col("ingest.embedding_model").alias("model"))


@Q("src07_validated_chunks", sql("chk", body="select count(*) filter (section_path is not null and regexp_matches(content_hash, '^sha256:[0-9a-f]{64}$') and page_end >= page_start and length(trim(text)) > 0) as good from chk"))
def src07(spark, folder):
    good, _ = readers.chunk_records(spark, _chunk_lines(spark, folder))
    return good.agg(F.count("*").alias("good"))


@Q("src08_last_duplicate", "select chunk_id, max_by(ingest.ingested_at, coalesce(ingest.ingested_at, '')) as ingested_at from chunks where chunk_id is not null group by 1")
def src08(spark, folder):
    c = table(spark, folder, "chunks").where("chunk_id is not null").withColumn("at", F.coalesce("ingest.ingested_at", F.lit("")))
    return readers.last_by_key(c, "chunk_id", "at").select("chunk_id", F.col("ingest.ingested_at").alias("ingested_at"))


@Q("src10_question_lines", sql("cap", body=f"select {collapsed('raw_query')} as question, count(*) as n from cap where length({collapsed('raw_query')}) > 0 group by 1"))
def src10(spark, folder):
    p = _fresh(spark, "questions")
    captures(spark, folder).select(F.coalesce(T.collapse(F.col("raw_query")), F.lit("")).alias("value")).write.text(p)
    return readers.questions(spark, p).groupBy("question").agg(F.count("*").alias("n"))


@Q("src12_table_scan", "select request_id, retriever_kind, top_k_requested from request_captures where retriever_kind = 'Hybrid'")
def src12(spark, folder):
    return table(spark, folder, "request_captures").where("retriever_kind = 'Hybrid'").select("request_id", "retriever_kind", "top_k_requested")


@Q("src14_collection_scroll", sql("chk", body="select chunk_id, doc_id from chk where chunking_version = 'v2'"))
def src14(spark, folder):
    return readers.scroll(chunks(spark, folder), {"chunking_version": "v2"}).select("chunk_id", "doc_id")


@Q("src16_span_scan", "select event_id, user_id, event_type from events where value > 50")
def src16(spark, folder):
    return table(spark, folder, "events").where("value > 50").select("event_id", "user_id", "event_type")


@Q("src18_point_get", sql("chk", body="with want as (select chunk_id from chk where chunk_index = 2 union all select 'unknown') select want.chunk_id, chk.doc_id from want left join chk using (chunk_id)"))
def src18(spark, folder):
    c = chunks(spark, folder)
    want = c.where("chunk_index = 2").select("chunk_id").unionByName(spark.createDataFrame([("unknown",)], "chunk_id string"))
    return want.join(c.select("chunk_id", "doc_id"), "chunk_id", "left")


@Q("snk01_jsonl_round_trip", "select o_orderkey, o_orderstatus, o_totalprice from orders")
def snk01(spark, folder):
    p = _fresh(spark, "orders")
    writers.json_lines(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), p)
    return readers.split_corrupt(readers.json_lines(spark, p, "o_orderkey bigint, o_orderstatus string, o_totalprice double"))[0]


@Q("snk02_reject_log", sql("chk", body="select chunk_id, 'validate' as stage from chk where section_path is null or not coalesce(regexp_matches(content_hash, '^sha256:[0-9a-f]{64}$'), false)"))
def snk02(spark, folder):
    _, bad = VA.split_rejects(chunks(spark, folder), VA.chunk_rules())
    p = _fresh(spark, "rejects")
    writers.append_rejects(bad.select("chunk_id", "chunk_index", F.lit("validate").alias("stage"), F.array_join("violations", ", ").alias("error")), p)
    return readers.split_corrupt(readers.json_lines(spark, p, schemas.REJECT))[0].select("chunk_id", "stage")


@Q("snk17_formatted_rows", "select l_orderkey::varchar as l_orderkey, coalesce(printf('%.4f', max(case when l_discount > 0.02 then l_discount end)), 'n/a') as most from lineitem group by l_orderkey")
def snk17(spark, folder):
    d = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.max(F.when(F.col("l_discount") > 0.02, F.col("l_discount"))).alias("most"))
    return writers.formatted(d)


@Q("stm06_resume_scope", sql("req", body="with s as (select request_id from req where run_id = '1-URGENT'), st as (select o_orderkey as request_id, o_orderstatus as status from orders) select request_id, status <> 'F' as open from s join st using (request_id)"))
def stm06(spark, folder):
    scope = requests(spark, folder).where("run_id = '1-URGENT'").select("request_id")
    st = table(spark, folder, "orders").select(F.col("o_orderkey").alias("request_id"), (F.col("o_orderstatus") != "F").alias("open"))
    return scope.join(st, "request_id")


# page geometry: order lines as words of a page -------------------------------------------------------

WORDS = "words as (select l_orderkey as page, 'w' || l_partkey as text, cast(l_linenumber as double) * 12 as top, l_extendedprice as x0, 6 + l_discount * 100 as size, cast(l_linenumber as double) * 12 + 8 as bottom, l_suppkey from lineitem)"


def _words(spark, folder):
    n = F.col("l_linenumber").cast("double")
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("page"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("text"), (n * 12).alias("top"), F.col("l_extendedprice").alias("x0"), (6 + F.col("l_discount") * 100).alias("size"), (n * 12 + 8).alias("bottom"), "l_suppkey")


@Q("doc01_superscripts", f"with {WORDS}, m as (select page, quantile_cont(size, 0.5) as usual from words group by 1) select page, count(*) filter (size <= 0.75 * usual and length(text) <= 3) as dropped, count(*) filter (not (size <= 0.75 * usual and length(text) <= 3)) as kept from words join m using (page) group by 1")
def doc01(spark, folder):
    usual = F.percentile("size", 0.5).over(Window.partitionBy("page"))
    w = _words(spark, folder).withColumn("small", (F.col("size") <= 0.75 * usual) & (F.length("text") <= 3))
    return w.groupBy("page").agg(F.count_if("small").alias("dropped"), F.count_if(~F.col("small")).alias("kept"))


LINES = f"{WORDS}, ln as (select page, top, max(bottom) as bottom, string_agg(text, ' ' order by x0, l_suppkey) as line from words group by 1, 2)"


def _lines(spark, folder):
    g = _words(spark, folder).groupBy("page", "top").agg(F.max("bottom").alias("bottom"), F.array_sort(F.collect_list(F.struct("x0", "l_suppkey", "text"))).alias("w"))
    return g.select("page", "top", "bottom", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("line"))


@Q("doc02_line_rules", f"with {LINES} select page, top, line from ln where not (starts_with(line, 'w1') and top <= 24) and not regexp_matches(line, '7$')")
def doc02(spark, folder):
    line = F.col("line")
    return _lines(spark, folder).where(~(line.startswith("w1") & (F.col("top") <= 24)) & ~line.rlike("7$")).select("page", "top", "line")


@Q("win10_line_gaps", f"with {LINES} select page, top, greatest(0, lead(top) over (partition by page order by top) - bottom) as gap from ln")
def win10(spark, folder):
    gap = F.lead("top").over(Window.partitionBy("page").orderBy("top")) - F.col("bottom")
    return _lines(spark, folder).select("page", "top", F.when(gap.isNotNull(), F.greatest(F.lit(0.0), gap)).otherwise(F.lit(0.0)).alias("gap"))


@Q("top14_lowest_rule", f"with {WORDS} select page, max_by(text, (top, x0, l_suppkey)) as lowest from words where size > 8 group by 1")
def top14(spark, folder):
    return _words(spark, folder).where("size > 8").groupBy("page").agg(F.max_by("text", F.struct("top", "x0", "l_suppkey")).alias("lowest"))


def _laid_out(spark, folder):
    word = F.transform(F.split("text", BLANKS), lambda w, i: F.struct(w.alias("text"), (F.floor(i / 8) * 12.0).alias("top"), (i % 8 * 40.0).alias("x0"), F.when(i % 17 == 3, F.lit(5.0)).otherwise(F.lit(10.0)).alias("size"), (F.floor(i / 8) * 12.0 + 10.0).alias("bottom")))
    return texts(spark, folder).select("doc_id", F.lit(1).alias("page"), word.alias("words"), F.lit(900.0).alias("page_height"))


@Q("doc03_block_rules")
def doc03(spark, folder):
    return CL.clean_pages(_laid_out(spark, folder), CL.PageRules(blocks=(CL.BlockRule(CL.TextAnchor("^See also"), most_lines=4, stops=(("gap", 2.0),), references=(("gap", "median_gap", 2.0),)),)))


@Q("doc04_conditional_blocks")
def doc04(spark, folder):
    """Blocks that are dropped only where their conditions hold, before the line rules."""
    tree = {"all": [{"kind": "candidate_line_count_gte", "value": 2}, {"not": {"kind": "candidate_line_count_gte", "value": 4}}]}
    rule = CL.BlockRule(CL.TextAnchor("^(?:See also|Contents)"), before_lines=True, most_lines=4, stops=(("gap", 2.0),), references=(("gap", "median_gap", 2.0),), when=tree)
    return CL.clean_pages(_laid_out(spark, folder), CL.PageRules(blocks=(rule,)))


@Q("win09_line_grouping")
def win09(spark, folder):
    return CL.clean_pages(_laid_out(spark, folder), CL.PageRules(y_tolerance=6.0, columns_at=160.0))


# text and scores ------------------------------------------------------------------------------------


@Q("str05_no_break_spaces", sql("doc", body=f"select doc_id, {collapsed('text')} = trim(text) as unchanged from doc"))
def str05(spark, folder):
    return texts(spark, folder).select("doc_id", (T.collapse(F.col("text")) == F.trim("text")).alias("unchanged"))


@Q("str09_heading_position", sql("chk", body="select chunk_id, position(lower(section_title) in lower(text)) as at from chk where section_title is not null and text is not null".replace(" as at", " as place")))
def str09(spark, folder):
    c = chunks(spark, folder).where("section_title is not null and text is not null")
    return c.select("chunk_id", F.expr("cast(locate(lower(section_title), lower(text)) as bigint)").alias("place"))


@Q("str12_word_tokens", sql("doc", body=r"select doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) as tokens from doc"))
def str12(spark, folder):
    return texts(spark, folder).select("doc_id", F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")).cast("bigint").alias("tokens"))


@Q("str17_phrase_bonus", sql("cap", body="select request_id, case when contains(lower(final_answer), lower(normalized_query)) then 1.0 when len(q) > 1 and len(list_filter(range(1, len(q)), lambda i: contains(lower(final_answer), q[i] || ' ' || q[i + 1]))) > 0 then 0.5 else 0.0 end as bonus from (select *, list_filter(string_split(lower(trim(normalized_query)), ' '), lambda t: strlen(t) > 1) as q from cap where length(trim(normalized_query)) > 0 and final_answer is not null)"))
def str17(spark, folder):
    c = captures(spark, folder).where("length(trim(normalized_query)) > 0 and final_answer is not null")
    terms = F.filter(F.split(F.lower(F.trim("normalized_query")), " "), lambda t: F.octet_length(t) > 1)
    return c.select("request_id", R.phrase_bonus(F.lower("normalized_query"), terms, F.lower("final_answer")).alias("bonus"))


@Q("str18_title_ratio", sql("chk", body="select chunk_id, round(len(list_intersect(list_distinct(a), b)) / len(list_distinct(a)), 6) as ratio from (select chunk_id, string_split(lower(document_title), ' ') as a, string_split(lower(coalesce(section_title, '') || ' ' || coalesce(doc_id, '')), ' ') as b from chk where length(document_title) > 0)"))
def str18(spark, folder):
    c = chunks(spark, folder).where("length(document_title) > 0")
    head = F.concat(F.coalesce("section_title", F.lit("")), F.lit(" "), F.coalesce("doc_id", F.lit("")))
    return c.select("chunk_id", r(R.coverage(F.split(F.lower("document_title"), " "), F.split(F.lower(head), " "))).alias("ratio"))


@Q("str21_heading_prefix", sql("chk", body="select chunk_id, length(case when starts_with(text, section_title) then ltrim(substr(text, length(section_title) + 1)) else text end) as n from chk where section_title is not null and text is not null"))
def str21(spark, folder):
    rest = F.when(F.expr("startswith(text, section_title)"), F.ltrim(F.expr("substr(text, length(section_title) + 1)"))).otherwise(F.col("text"))
    return chunks(spark, folder).where("section_title is not null and text is not null").select("chunk_id", F.length(rest).alias("n"))


@Q("str24_significant_gap", sql("chk", body=r"select chunk_id, length(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) > 400 and regexp_matches(text, '[.!?]') as significant from chk where text is not null"))
def str24(spark, folder):
    t = F.col("text")
    return chunks(spark, folder).where("text is not null").select("chunk_id", ((F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]+", "")) > 400) & t.rlike("[.!?]")).alias("significant"))


@Q("mth02_weighted_score", sql("ret", body="select request_id, rank, round(0.5 * retrieval_score + 2.0 * score + 1.0 / rank, 6) as total from ret"))
def mth02(spark, folder):
    return retrieval_results(spark, folder).select("request_id", "rank", r(0.5 * F.col("retrieval_score") + 2.0 * F.col("score") + 1.0 / F.col("rank")).alias("total"))


@Q("top07_selected_flag", sql("ret", body="select request_id, count(*) filter (rank <= 3) as selected, count(*) filter (rank > 3) as passed_over from ret group by 1"))
def top07(spark, folder):
    s = R.select_final(retrieval_results(spark, folder), 3)
    return s.groupBy("request_id").agg(F.count_if("selected").alias("selected"), F.count_if(~F.col("selected")).alias("passed_over"))


@Q("jsn02_quote_repair", """select event_id, 'a "' || event_type || '" b' as label from events""")
def jsn02(spark, folder):
    """Replies with unescaped quotes inside, repaired."""
    e = table(spark, folder, "events")
    broken = F.concat(F.lit('note: {"label": "a "'), F.col("event_type"), F.lit('" b", "n": '), F.col("event_id").cast("string"), F.lit("}"))
    return e.select("event_id", F.get_json_object(jsonfix.tolerant_object(broken), "$.label").alias("label"))


@Q("dtm02_utc_stamp", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as stamp from orders")
def dtm02(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"))


@Q("val01_typed_instances", "select event_id, list_filter([case when try_cast(props ->> '$.k' as bigint) is null then 'k' end, case when value < 0 then 'value' end, case when length(trim(event_type)) = 0 then 'event_type' end], lambda x: x is not null) as violations from events")
def val01(spark, folder):
    rules = {"k": F.get_json_object("props", "$.k").try_cast("bigint").isNotNull(), "value": F.col("value") >= 0, "event_type": VA.filled("event_type")}
    return table(spark, folder, "events").select("event_id", VA.violations(rules).alias("violations"))


@Q("val13_artifact_health", "select collection_name, created_at, document_count is not null as has_count, average_document_length > 0 as has_length, vocabulary_name in (select vocabulary_name from sparse_vocabulary) as has_vocabulary from bm25_term_stats")
def val13(spark, folder):
    names = table(spark, folder, "sparse_vocabulary").select("vocabulary_name").distinct().withColumn("known", F.lit(True))
    t = table(spark, folder, "bm25_term_stats").join(names, "vocabulary_name", "left")
    return t.select("collection_name", "created_at", F.col("document_count").isNotNull().alias("has_count"), (F.col("average_document_length") > 0).alias("has_length"), F.coalesce("known", F.lit(False)).alias("has_vocabulary"))


@Q("val18_vocabulary_identity", "select vocabulary_name, count(*) as tokens, count(distinct token) = count(*) as unique_tokens, max(token_id) = count(*) - 1 and min(token_id) = 0 and count(distinct token_id) = count(*) as contiguous from sparse_vocabulary group by 1")
def val18(spark, folder):
    n = F.count("*")
    return table(spark, folder, "sparse_vocabulary").groupBy("vocabulary_name").agg(n.alias("tokens"), (F.count_distinct("token") == n).alias("unique_tokens"), ((F.max("token_id") == n - 1) & (F.min("token_id") == 0) & (F.count_distinct("token_id") == n)).alias("contiguous"))


@Q("val17_ordered_hits", sql("ret", body="select request_id, bool_and(rank = rn) as ordered, bool_and(retrieval_score is not null) as scored from (select *, row_number() over (partition by request_id order by rank) as rn from ret) group by 1"))
def val17(spark, folder):
    rn = F.row_number().over(Window.partitionBy("request_id").orderBy("rank"))
    rows = retrieval_results(spark, folder).withColumn("ok", F.col("rank") == rn)
    return rows.groupBy("request_id").agg(F.bool_and("ok").alias("ordered"), F.bool_and(F.col("retrieval_score").isNotNull()).alias("scored"))


@Q("udf05_embed_queries")
def udf05(spark, folder):
    return SV.embed(captures(spark, folder).select("request_id", "normalized_query"), "request_id", "normalized_query")


@Q("udf08_judge_chunks")
def udf08(spark, folder):
    return SV.score_pairs(rerank_candidates(spark, folder), ["query_id", "item_id"], "query", "body", attempts=2)


@Q("udf10_row_predicates", sql("ret", body="select request_id, bool_and(score in (0.0, 0.5, 1.0) and chunk_id > 0) as valid from ret group by 1"))
def udf10(spark, folder):
    items = retrieval_results(spark, folder).groupBy("request_id").agg(F.collect_list(F.struct("score", "chunk_id")).alias("x"))
    return items.select("request_id", F.forall("x", lambda i: i["score"].isin(0.0, 0.5, 1.0) & (i["chunk_id"] > 0)).alias("valid"))


@Q("udf11_judge_token_use")
def udf11(spark, folder):
    s = SV.score_pairs(captures(spark, folder), ["request_id", "retriever_kind"], "raw_query", "final_answer")
    return s.groupBy("retriever_kind").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pairs"))
