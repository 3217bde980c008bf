"""Ingest and incremental evaluation: keyed writes, change classification, state, validation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import jsonfix
from ..operators import services as SV
from ..operators import upsert as U
from ..operators import validate as VA
from ..session import materialise
from .entities import captures, chunks, generation_results, requests, rerank_candidates, retrieval_results, sql
from .registry import Registry, table

REGISTRY = Registry()
Q = REGISTRY.query
OLD = "old as (select l_orderkey as request_id, max(l_linestatus) as status, round(sum(l_extendedprice), 2) as score, max(l_shipdate) as summarized_at from lineitem group by 1)"
NEW = "new as (select o_orderkey as request_id, o_orderstatus as status, o_totalprice as score, o_orderdate as summarized_at from orders)"


def _old_new(spark, folder):
    """Summaries of the order lines as the old table, the orders as what comes in: some orders have
    no lines, and either side may be the later one."""
    old = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("request_id")).agg(F.max("l_linestatus").alias("status"), F.round(F.sum("l_extendedprice"), 2).alias("score"), F.max("l_shipdate").alias("summarized_at"))
    new = table(spark, folder, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("score"), F.col("o_orderdate").alias("summarized_at"))
    return old, new


@Q("snk10_append_calls", f"with {OLD}, {NEW} select request_id, status from old union all select request_id, status from new")
def snk10(spark, folder):
    old, new = _old_new(spark, folder)
    return old.unionByName(new).select("request_id", "status")


@Q("snk11_upsert_request_summary", f"with {OLD}, {NEW} select request_id, status, score from (select *, row_number() over (partition by request_id order by summarized_at desc, src desc) as rn from (select *, 0 as src from old union all select *, 1 from new)) where rn = 1")
def snk11(spark, folder):
    old, new = _old_new(spark, folder)
    return U.upsert(old, new, ["request_id"], "summarized_at").select("request_id", "status", "score")


@Q("snk12_upsert_run_summary", f"with {OLD}, {NEW} select request_id, status, score from (select *, row_number() over (partition by request_id, status order by summarized_at desc, src desc) as rn from (select *, 0 as src from old union all select *, 1 from new)) where rn = 1")
def snk12(spark, folder):
    old, new = _old_new(spark, folder)
    return U.upsert(old, new, ["request_id", "status"], "summarized_at").select("request_id", "status", "score")


@Q("snk05_update_payload", f"with {OLD}, {NEW} select old.request_id, coalesce(new.status, old.status) as status, old.score from old left join new using (request_id)")
def snk05(spark, folder):
    old, new = _old_new(spark, folder)
    return U.update_changed(old, new, "request_id", ["status"]).select("request_id", "status", "score")


@Q("snk04_replace_points", f"with {OLD}, {NEW} select request_id, status from old where request_id not in (select request_id from new) union all select request_id, status from new")
def snk04(spark, folder):
    old, new = _old_new(spark, folder)
    return old.join(new.select("request_id"), "request_id", "left_anti").unionByName(new).select("request_id", "status")


PRINT_SQL = "sha256(coalesce(text, 'null'))"
OLDC = f"oldc as (select chunk_id, case when hash(1) = hash(1) and chunk_index % 5 = 0 then 'stale' else {PRINT_SQL} end as print, coalesce(section_title, '') || case when chunk_index % 3 = 0 then ' (old)' else '' end as meta from chk where chunk_index % 4 <> 1)"


def _cdc(spark, folder):
    c = chunks(spark, folder)
    print_ = F.sha2(F.coalesce("text", F.lit("null")), 256)
    title = F.coalesce("section_title", F.lit(""))
    old = c.where("chunk_index % 4 <> 1").select("chunk_id", F.when(F.col("chunk_index") % 5 == 0, "stale").otherwise(print_).alias("print"), F.concat(title, F.when(F.col("chunk_index") % 3 == 0, " (old)").otherwise("")).alias("meta"))
    return old, c.select("chunk_id", print_.alias("print"), title.alias("meta"))


CDC = f"with {OLDC}, newc as (select chunk_id, {PRINT_SQL} as print, coalesce(section_title, '') as meta from chk), act as (select chunk_id, case when o.chunk_id is null then 'insert' when n.print <> o.print then 'skip_and_log' when n.meta <> o.meta then 'update' else 'skip' end as action from newc n left join oldc o using (chunk_id))"


@Q("snk18_change_classifier", sql("chk", body=CDC + " select chunk_id, action from act"))
def snk18(spark, folder):
    return U.classify_changes(*_cdc(spark, folder), "chunk_id")


@Q("agg34_change_counters", sql("chk", body=CDC + " select action, count(*) as n from act group by 1"))
def agg34(spark, folder):
    return U.classify_changes(*_cdc(spark, folder), "chunk_id").groupBy("action").agg(F.count("*").alias("n"))


@Q("snk15_ingest_manifest", sql("chk", body=CDC + ", m as (select count(*) as total, count(*) filter (action in ('insert', 'update')) as processed, count(*) filter (action in ('skip', 'skip_and_log')) as skipped, 0 as failed from act) select total, processed, skipped, failed, total = processed + skipped + failed as balanced from m"))
def snk15(spark, folder):
    a = U.classify_changes(*_cdc(spark, folder), "chunk_id")
    m = a.agg(F.count("*").alias("total"), F.count_if(F.col("action").isin("insert", "update")).alias("processed"), F.count_if(F.col("action").isin("skip", "skip_and_log")).alias("skipped"), F.lit(0).alias("failed"))
    return m.withColumn("balanced", F.col("total") == F.col("processed") + F.col("skipped") + F.col("failed"))


@Q("snk20_fingerprint", sql("chk", body="""select chunk_id, sha256('["' || chunk_id || '","' || coalesce(page_start::varchar, 'null') || '"]') as fingerprint from chk"""))
def snk20(spark, folder):
    return chunks(spark, folder).select("chunk_id", U.fingerprint([F.col("chunk_id"), F.col("page_start")]).alias("fingerprint"))


@Q("snk21_content_hash", sql("chk", body="select chunk_id, 'sha256:' || sha256(text) as computed, lower(content_hash) = 'sha256:' || sha256(text) as agrees from chk where text is not null"))
def snk21(spark, folder):
    h = U.content_hash(F.col("text"))
    return chunks(spark, folder).where("text is not null").select("chunk_id", h.alias("computed"), (F.lower("content_hash") == h).alias("agrees"))


@Q("snk22_collection_compatibility", "select collection_name, list_filter([case when vocabulary_name is null then 'vocabulary' end, case when sparse_strategy.kind <> 'bm25_like' then 'strategy' end, case when document_count is null or document_count <= 0 then 'document_count' end], lambda x: x is not null) as mismatches, created_at from bm25_term_stats")
def snk22(spark, folder):
    t = table(spark, folder, "bm25_term_stats")
    m = F.array_compact(F.array(F.when(F.col("vocabulary_name").isNull(), "vocabulary"), F.when(F.col("sparse_strategy.kind") != "bm25_like", "strategy"), F.when(F.col("document_count").isNull() | (F.col("document_count") <= 0), "document_count")))
    return t.select("collection_name", m.alias("mismatches"), "created_at")


@Q("val19_term_stats_checks", "select collection_name, created_at, coalesce(average_document_length > 0, false) as avgdl_ok, coalesce(document_count is not null and len(list_filter(map_values(document_frequency_by_token_id), lambda x: x > document_count)) = 0, false) as df_ok from bm25_term_stats")
def val19(spark, folder):
    t = table(spark, folder, "bm25_term_stats")
    over = F.size(F.filter(F.map_values("document_frequency_by_token_id"), lambda x: x > F.col("document_count"))) == 0
    return t.select("collection_name", "created_at", F.coalesce(F.col("average_document_length") > 0, F.lit(False)).alias("avgdl_ok"), F.coalesce(F.col("document_count").isNotNull() & over, F.lit(False)).alias("df_ok"))


# state machine ------------------------------------------------------------------------------------

STATE0 = "st as (select o_orderkey as request_id, 'judge_generation' as stage, case when o_orderstatus = 'F' then 'completed' else 'pending' end as status, 0 as attempts from orders where o_orderkey in (select l_orderkey from lineitem))"


def _state0(spark, folder):
    """A state row for every order with lines; the finished orders are completed."""
    o = table(spark, folder, "orders").join(table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    return o.select(F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").alias("received_at"), F.lit("judge_generation").alias("stage"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("pending").alias("status"), F.lit(0).alias("attempts"))


@Q("stm01_bootstrap", f"with {STATE0} select o_orderkey as request_id, 'judge_generation' as stage, 'pending' as status, 0 as attempts from orders where o_orderkey not in (select request_id from st)")
def stm01(spark, folder):
    return U.bootstrap(requests(spark, folder), _state0(spark, folder)).drop("received_at")


@Q("stm03_promotion", f"with {STATE0} select request_id, case when status = 'completed' then 'judge_retrieval' else stage end as stage, 'pending' as status, attempts from st")
def stm03(spark, folder):
    return U.promote(_state0(spark, folder)).drop("received_at")


@Q("stm04_transitions", f"with {STATE0}, oc as (select o_orderkey as request_id, o_orderstatus = 'O' as ok from orders where o_orderstatus <> 'F') select request_id, stage, case when ok is null then status when ok then 'completed' else 'failed' end as status, attempts + (ok is not null)::int as attempts from st left join oc using (request_id)")
def stm04(spark, folder):
    outcome = table(spark, folder, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("request_id"), (F.col("o_orderstatus") == "O").alias("ok"))
    return U.transition(_state0(spark, folder), outcome).drop("received_at")


@Q("stm02_drain", f"with {STATE0} select 'completed' as status, count(*) as n from st")
def stm02(spark, folder):
    work = lambda todo: todo.select("request_id", ((F.col("request_id") + F.col("attempts")) % 3 != 0).alias("ok"))
    done = U.drain(materialise(_state0(spark, folder), "state"), "judge_generation", lambda todo: materialise(work(todo), "outcome"))
    return done.groupBy("status").agg(F.count("*").alias("n"))


@Q("stm05_completion_check", f"with {STATE0} select count(*) filter (status <> 'completed') as incomplete, count(*) filter (status <> 'completed') = 0 as complete from st")
def stm05(spark, folder):
    n = F.count_if(F.col("status") != "completed")
    return _state0(spark, folder).agg(n.alias("incomplete"), (n == 0).alias("complete"))


@Q("stm07_resume_candidates", sql("req", body=f"with {STATE0} select run_id, bool_or(coalesce(status <> 'completed', false)) as overlaps, count(*) filter (status <> 'completed') as open_requests from req left join st using (request_id) group by 1"))
def stm07(spark, folder):
    open_ = _state0(spark, folder).where("status <> 'completed'").select("request_id").withColumn("hit", F.lit(True))
    hit = F.coalesce("hit", F.lit(False))
    return requests(spark, folder).join(open_, "request_id", "left").groupBy("run_id").agg(F.bool_or(hit).alias("overlaps"), F.count_if(hit).alias("open_requests"))


# validation ---------------------------------------------------------------------------------------

CHUNK_RULES = """list_filter([case when not coalesce(schema_version = 1, false) then 'schema_version' end, """ + ", ".join(f"case when not coalesce(length(trim({c})) > 0, false) then '{c}' end" for c in ("doc_id", "chunk_id", "url", "document_title", "chunking_version", "text")) + """, case when not coalesce(chunk_index >= 0, false) then 'chunk_index' end, case when not coalesce(page_start >= 1, false) then 'page_start' end, case when not coalesce(page_end >= page_start, false) then 'page_range' end, case when not coalesce(regexp_matches(content_hash, '^sha256:[0-9a-f]{64}$'), false) then 'content_hash' end, case when section_path is null then 'section_path' end], lambda x: x is not null)"""


@Q("val02_chunk_violations", sql("chk", body=f"select chunk_id, list_sort(v) as violations from (select chunk_id, {CHUNK_RULES} as v from chk) where len(v) > 0"))
def val02(spark, folder):
    _, bad = VA.split_rejects(chunks(spark, folder), VA.chunk_rules())
    return bad.select("chunk_id", F.array_sort("violations").alias("violations"))


@Q("val03_good_and_rejected", sql("chk", body=f"select len({CHUNK_RULES}) = 0 as good, count(*) as n from chk group by 1"))
def val03(spark, folder):
    good, bad = VA.split_rejects(chunks(spark, folder), VA.chunk_rules())
    rows = good.select(F.lit(True).alias("good")).unionByName(bad.select(F.lit(False).alias("good")))
    return rows.groupBy("good").agg(F.count("*").alias("n"))


@Q("val06_capture_checks", sql("cap", body="select count(*) filter (not coalesce(total_tokens = prompt_tokens + completion_tokens, false)) as token_sum, count(*) filter (not coalesce(top_k_requested > 0, false)) as top_k, count(*) filter (not coalesce(length(trim(runtime_run_id)) > 0, false)) as run from cap"))
def val06(spark, folder):
    rules = VA.capture_rules()
    broken = lambda n: F.count_if(~F.coalesce(rules[n], F.lit(False))).alias(n)
    return captures(spark, folder).agg(broken("token_sum"), broken("top_k"), broken("run"))


@Q("val16_capture_violations", sql("cap", body="select request_id, reranker_kind, (reranker_config is null) = (reranker_kind = 'PassThrough') as config_ok from cap"))
def val16(spark, folder):
    ok = VA.capture_rules()["reranker_config"]
    return captures(spark, folder).select("request_id", "reranker_kind", ok.alias("config_ok"))


@Q("val04_referential", "select 'customer without order' as finding, c_custkey as key from customer where c_custkey not in (select o_custkey from orders) union all select 'order without line', o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def val04(spark, folder):
    o = table(spark, folder, "orders")
    a = VA.orphans(table(spark, folder, "customer").select(F.col("c_custkey").alias("key")), o.select(F.col("o_custkey").alias("key")), "key").withColumn("finding", F.lit("customer without order"))
    b = VA.orphans(o.select(F.col("o_orderkey").alias("key")), table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("key")), "key").withColumn("finding", F.lit("order without line"))
    return a.unionByName(b)


@Q("val04_duplicate_keys", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def val04d(spark, folder):
    return VA.duplicate_keys(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@Q("val05_nested_checks", sql("ret", body="select request_id, bool_and(chunk_id is not null and score between 0 and 1) as items_ok, bool_or(rank <= 4) as some_selected from ret group by 1"))
def val05(spark, folder):
    nested = retrieval_results(spark, folder).groupBy("request_id").agg(F.collect_list(F.struct("chunk_id", "score", "rank")).alias("rr"))
    return nested.select("request_id", F.forall("rr", lambda x: x["chunk_id"].isNotNull() & x["score"].between(0, 1)).alias("items_ok"), F.exists("rr", lambda x: x["rank"] <= 4).alias("some_selected"))


@Q("val07_golden_consistency", sql("ret", body="select request_id, count(*) filter (score >= 0.5) > 0 as soft_filled, true as strict_in_soft from ret group by 1"))
def val07(spark, folder):
    pick = lambda c: F.collect_set(F.when(c, F.col("chunk_id")))
    g = retrieval_results(spark, folder).groupBy("request_id").agg(pick(F.col("score") >= 0.5).alias("soft"), pick(F.col("score") == 1.0).alias("strict"), F.collect_list(F.struct(F.col("chunk_id").alias("item_id"), F.col("score").alias("grade"))).alias("graded"))
    rules = VA.golden_rules()
    return g.select("request_id", rules["soft_empty"].alias("soft_filled"), rules["strict_not_in_soft"].alias("strict_in_soft"))


@Q("val08_readiness", sql("gen", body="select request_id, run_id, len(list_distinct(list(suite_name))) = 4 as ready from gen group by 1, 2"))
def val08(spark, folder):
    need = F.array(*[F.lit(s) for s in ("answer_completeness", "answer_relevance", "correct_refusal", "groundedness")])
    return generation_results(spark, folder).groupBy("request_id", "run_id").agg(VA.same_members(F.collect_set("suite_name"), need).alias("ready"))


@Q("val09_query_validation", sql("cap", body=r"with q as (select request_id, trim(regexp_replace(raw_query, '\s+', ' ', 'g')) as query from cap) select request_id, query, case when query is null or query = '' then 'empty' when len(string_split(query, ' ')) > 24 then 'too long' end as problem from q"))
def val09(spark, folder):
    from ..functions.text import collapse

    query = collapse(F.col("raw_query"))
    problem = F.when(query.isNull() | (query == ""), "empty").when(F.size(F.split(query, " ")) > 24, "too long")
    return captures(spark, folder).select("request_id", query.alias("query"), problem.alias("problem"))


@Q("val10_embedding_checks", "select vec_id, len(embedding) = 64 as dimension_ok, round(list_dot_product(embedding::double[], embedding::double[]), 3) as norm from embeddings")
def val10(spark, folder):
    from ..operators.retrieval import unit_dot

    return table(spark, folder, "embeddings").select("vec_id", (F.size("embedding") == 64).alias("dimension_ok"), F.round(unit_dot("embedding", "embedding"), 3).alias("norm"))


@Q("val11_permutation", sql("ret", body="select request_id, list_sort(list(rank - 1)) = range(0, count(*)) as permutation from ret group by 1"))
def val11(spark, folder):
    return retrieval_results(spark, folder).groupBy("request_id").agg(VA.permutation(F.collect_list(F.col("rank") - 1), F.count("*").cast("int")).alias("permutation"))


@Q("val12_payload_health", "with d as (select count(*) as dup from (select chunk_id from chunks group by 1 having count(*) > 1)) select count(*) as points, count(*) filter (section_title is null) as no_section, count(*) filter (ingest is null) as no_ingest, count(*) filter (page_end < page_start) as bad_pages, (select dup from d) as duplicated from chunks")
def val12(spark, folder):
    c = table(spark, folder, "chunks")
    counts = c.agg(F.count("*").alias("points"), F.count_if(F.col("section_title").isNull()).alias("no_section"), F.count_if(F.col("ingest").isNull()).alias("no_ingest"), F.count_if(F.col("page_end") < F.col("page_start")).alias("bad_pages"))
    return counts.crossJoin(VA.duplicate_keys(c, ["chunk_id"]).agg(F.count("*").alias("duplicated")))


@Q("val21_inherited_fields", "with p as (select o_orderkey, o_custkey, o_orderstatus from orders) select l_orderkey, count(*) as children, count(*) filter (o_orderkey is null or (l_linestatus = 'O') <> (o_orderstatus = 'O')) as violations from lineitem left join p on l_orderkey = o_orderkey group by 1")
def val21(spark, folder):
    p = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    rows = table(spark, folder, "lineitem").join(p, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    bad = F.col("o_orderkey").isNull() | ((F.col("l_linestatus") == "O") != (F.col("o_orderstatus") == "O"))
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("children"), F.count_if(bad).alias("violations"))


@Q("jon21_inherit", sql("chk", body="select chunk_id, i as part, document_title, page_start from (select chunk_id, document_title, page_start, unnest(range(0, page_end - page_start + 1)) as i from chk where page_end >= page_start)"))
def jon21(spark, folder):
    c = chunks(spark, folder).where("page_end >= page_start")
    return c.select("chunk_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("page_end") - F.col("page_start"))).alias("part"), "document_title", "page_start")


# model calls and replies --------------------------------------------------------------------------


@Q("udf04_embed_chunks")
def udf04(spark, folder):
    return SV.embed(chunks(spark, folder).select("chunk_id", "text"), "chunk_id", "text")


@Q("udf06_generate")
def udf06(spark, folder):
    return SV.generate(captures(spark, folder).select("request_id", "raw_query"), "request_id", "raw_query")


@Q("udf07_judge_answers")
def udf07(spark, folder):
    return SV.score_pairs(captures(spark, folder), ["request_id"], "raw_query", "final_answer")


@Q("udf03_cross_encoder")
def udf03(spark, folder):
    from ..operators.rerank import merge_batches

    scored = SV.score_pairs(rerank_candidates(spark, folder).withColumnRenamed("rank", "original"), ["query_id", "item_id", "original"], "query", "body").withColumnRenamed("model_score", "score")
    return merge_batches(scored, "query_id", 4, True)


@Q("jsn01_judge_replies", "select request_id, suite_name, raw_response ->> '$.label' as label, coalesce(json_valid(raw_response), false) as readable from judge_generation_results")
def jsn01(spark, folder):
    reply = table(spark, folder, "judge_generation_results").select("request_id", "suite_name", "raw_response")
    fixed = reply.withColumn("object", jsonfix.tolerant_object(F.col("raw_response")))
    return fixed.select("request_id", "suite_name", F.get_json_object("object", "$.label").alias("label"), F.col("object").isNotNull().alias("readable"))


@Q("jsn03_reply_text", "select event_id, coalesce(nullif(j ->> '$.choices[0].message.content', ''), nullif(j ->> '$.response', ''), nullif(j ->> '$.text', '')) as reply from (select event_id, case event_id % 3 when 0 then json_object('choices', json_array(json_object('message', json_object('content', event_type)))) when 1 then json_object('response', event_type) else json_object('response', '', 'text', event_type) end as j from events)")
def jsn03(spark, folder):
    e = table(spark, folder, "events")
    t = F.col("event_type")
    shaped = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.array(F.struct(F.struct(t.alias("content")).alias("message"))).alias("choices")))).when(F.col("event_id") % 3 == 1, F.to_json(F.struct(t.alias("response")))).otherwise(F.to_json(F.struct(F.lit("").alias("response"), t.alias("text"))))
    return e.select("event_id", jsonfix.reply_text(shaped).alias("reply"))


@Q("jsn04_normalised_judgement", sql("gen", body="select request_id, run_id, suite_name, label, label is not null and explanation is not null and length(trim(explanation)) > 0 as usable from gen"))
def jsn04(spark, folder):
    ok = F.col("label").isNotNull() & F.col("explanation").isNotNull() & (F.length(F.trim("explanation")) > 0)
    return generation_results(spark, folder).select("request_id", "run_id", "suite_name", "label", ok.alias("usable"))


@Q("jsn05_metrics_unpack", sql("cap", body="select request_id, round(try_cast((try_cast(retrieval_stage_metrics as json) ->> '$.recall_soft') as double), 6) as recall_soft from cap where json_valid(retrieval_stage_metrics) and json_type(retrieval_stage_metrics) = 'OBJECT'"))
def jsn05(spark, folder):
    c = captures(spark, folder).withColumn("m", F.try_parse_json("retrieval_stage_metrics"))
    return c.where(F.schema_of_variant("m").startswith("OBJECT")).select("request_id", F.round(F.get_json_object("retrieval_stage_metrics", "$.recall_soft").try_cast("double"), 6).alias("recall_soft"))


@Q("jsn06_usage_source", sql("cap", body="select request_id, coalesce(total_tokens, prompt_tokens + completion_tokens, len(string_split(coalesce(final_answer, ''), ' '))) as tokens, case when total_tokens is not null then 'provider' when prompt_tokens + completion_tokens is not null then 'parts' else 'estimate' end as source from cap"))
def jsn06(spark, folder):
    parts = F.col("prompt_tokens") + F.col("completion_tokens")
    return captures(spark, folder).select("request_id", F.coalesce("total_tokens", parts, F.size(F.split(F.coalesce("final_answer", F.lit("")), " "))).alias("tokens"), F.when(F.col("total_tokens").isNotNull(), "provider").when(parts.isNotNull(), "parts").otherwise("estimate").alias("source"))


@Q("jsn07_list_parse", "select event_id, len(string_split(event_type, 'e')) as n from events")
def jsn07(spark, folder):
    listed = F.to_json(F.split("event_type", "e"))
    return table(spark, folder, "events").select("event_id", F.size(F.from_json(listed, "array<string>")).cast("bigint").alias("n"))


@Q("dtm01_iso_timestamps", sql("chk", body="select chunk_id, epoch_us(try_cast(chunk_created_at as timestamptz)) as created_us from chk"))
def dtm01(spark, folder):
    return chunks(spark, folder).select("chunk_id", F.unix_micros(F.expr("try_cast(chunk_created_at as timestamp)")).alias("created_us"))


@Q("dtm03_run_label", sql("req", body="select run_id, strftime(min(received_at), '%Y-%m-%d %H:%M') || ' ' || run_id as label from req group by 1"))
def dtm03(spark, folder):
    return requests(spark, folder).groupBy("run_id").agg(F.min("received_at").alias("at")).select("run_id", F.concat(F.date_format("at", "yyyy-MM-dd HH:mm"), F.lit(" "), "run_id").alias("label"))


@Q("win21_stable_timestamps", sql("chk", body="select chunk_id, strftime(timestamp '2026-01-01 00:00:00' + to_minutes(chunk_index::int), '%Y-%m-%dT%H:%M:%SZ') as stamp from chk"))
def win21(spark, folder):
    at = F.timestamp_add("MINUTE", F.col("chunk_index").cast("int"), F.to_timestamp(F.lit("2026-01-01 00:00:00")))
    return chunks(spark, folder).select("chunk_id", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"))


@Q("arr02_batches", "select o_orderkey, (row_number() over (partition by o_orderpriority order by o_orderkey) - 1) // 64 as batch from orders")
def arr02(spark, folder):
    w = Window.partitionBy("o_orderpriority").orderBy("o_orderkey")
    return table(spark, folder, "orders").select("o_orderkey", F.floor((F.row_number().over(w) - 1) / 64).alias("batch"))
