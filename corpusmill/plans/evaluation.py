"""Evaluation of captured requests: joins of fact tables, roll-ups, label distributions, run
comparisons, set operations and top lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from .entities import captures, generation_results, judge_calls, requests, retrieval_results, sql
from .registry import Registry, table

REGISTRY = Registry()
Q = REGISTRY.query
A_RUN, B_RUN = "1-URGENT", "2-HIGH"
SUITES = ["answer_completeness", "answer_relevance", "correct_refusal", "groundedness"]
SUITE_LIST = ", ".join(f"'{s}'" for s in SUITES)


def r(col, digits=6):
    return F.round(col, digits)


# joins --------------------------------------------------------------------------------------------


@Q("jon01_new_requests", sql("req", body="select request_id, received_at from req where not exists (select 1 from lineitem where l_orderkey = request_id)"))
def jon01(spark, folder):
    done = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("request_id"))
    return requests(spark, folder).join(done, "request_id", "left_anti").select("request_id", "received_at")


MEMBERS = """a as (select request_id, count(*) as n_gen from gen group by 1), b as (select request_id, count(*) as n_cap from cap where runtime_run_id is not null group by 1)"""


@Q("jon02_run_membership", sql("gen", "cap", body=f"with {MEMBERS} select request_id, coalesce(n_gen, 0) as judged, coalesce(n_cap, 0) as captured from a full join b using (request_id)"))
def jon02(spark, folder):
    a = generation_results(spark, folder).groupBy("request_id").agg(F.count("*").alias("n_gen"))
    b = captures(spark, folder).where("runtime_run_id is not null").groupBy("request_id").agg(F.count("*").alias("n_cap"))
    return a.join(b, "request_id", "full").select("request_id", F.coalesce("n_gen", F.lit(0)).alias("judged"), F.coalesce("n_cap", F.lit(0)).alias("captured"))


@Q("jon03_runs_for_request", sql("gen", "cap", body="""with a as (select run_id, count(*) as judged from gen group by 1), b as (select runtime_run_id as run_id, count(*) as captured from cap group by 1)
 select coalesce(a.run_id, b.run_id) as run_id, coalesce(judged, 0) as judged, coalesce(captured, 0) as captured from a full join b on a.run_id = b.run_id"""))
def jon03(spark, folder):
    a = generation_results(spark, folder).groupBy("run_id").agg(F.count("*").alias("judged"))
    b = captures(spark, folder).groupBy(F.col("runtime_run_id").alias("run_id")).agg(F.count("*").alias("captured"))
    return a.join(b, "run_id", "full").select("run_id", F.coalesce("judged", F.lit(0)).alias("judged"), F.coalesce("captured", F.lit(0)).alias("captured"))


@Q("jon04_request_matrix", sql("req", "ret", "calls", body="""with a as (select request_id, count(*) as chunks, sum(score) as s from ret group by 1), b as (select request_id, count(*) as calls from calls where stage = 'judge_retrieval' group by 1), f as (select coalesce(a.request_id, b.request_id) as request_id, chunks, s, calls from a full join b on a.request_id = b.request_id)
 select req.request_id, run_id, coalesce(chunks, 0) as chunks, coalesce(calls, 0) as calls, round(coalesce(s, 0), 4) as score from req left join f using (request_id)"""))
def jon04(spark, folder):
    a = retrieval_results(spark, folder).groupBy("request_id").agg(F.count("*").alias("chunks"), F.sum("score").alias("s"))
    b = judge_calls(spark, folder).where("stage = 'judge_retrieval'").groupBy("request_id").agg(F.count("*").alias("calls"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return requests(spark, folder).join(a.join(b, "request_id", "full"), "request_id", "left").select("request_id", "run_id", zero("chunks").alias("chunks"), zero("calls").alias("calls"), r(zero("s"), 4).alias("score"))


PAIRS = f"""x as (select question_id as question, label, (sum(cast(score * 2 as bigint)) * 5000 // count(*)) / 10000 as score from req join ret using (request_id) where run_id = '{A_RUN}' group by 1, 2),
 y as (select question_id as question, label, (sum(cast(score * 90 as bigint) + cast(round(retrieval_score * 100) as bigint)) * 100 // count(*)) / 10000 as score from req join ret using (request_id) where run_id = '{B_RUN}' group by 1, 2)"""


def _pairs(spark, folder):
    rows = requests(spark, folder).join(retrieval_results(spark, folder), "request_id").withColumn("question", F.col("question_id"))
    x = rows.where(F.col("run_id") == A_RUN).groupBy("question", "label").agg(F.expr("(sum(cast(score * 2 as bigint)) * 5000 div count(*)) / 10000D").alias("score_a"))
    y = rows.where(F.col("run_id") == B_RUN).groupBy("question", "label").agg(F.expr("(sum(cast(score * 90 as bigint) + cast(round(retrieval_score * 100) as bigint)) * 100 div count(*)) / 10000D").alias("score_b"))
    return x.join(y, ["question", "label"], "full")


@Q("jon05_regression_pairs", sql("req", "ret", body=f"with {PAIRS} select question, label, x.score as score_a, y.score as score_b from x full join y using (question, label)"))
def jon05(spark, folder):
    return _pairs(spark, folder)


@Q("cmp07_run_regressions", sql("req", "ret", body=f"""with {PAIRS}, p as (select question, label, x.score as score_a, y.score as score_b from x full join y using (question, label))
 select question, label, score_a, score_b, case when score_b is null then 'missing' else 'lower' end as regression_kind, round(score_a - score_b, 6) as delta from p where score_a is not null and (score_b is null or score_b < score_a)
 order by (score_b is null) desc, delta desc nulls last, question, label limit 50"""))
def cmp07(spark, folder):
    p = _pairs(spark, folder).where("score_a is not null and (score_b is null or score_b < score_a)")
    p = p.withColumn("regression_kind", F.when(F.col("score_b").isNull(), "missing").otherwise("lower")).withColumn("delta", r(F.col("score_a") - F.col("score_b")))
    return p.orderBy(F.col("score_b").isNull().desc(), F.desc_nulls_last("delta"), "question", "label").limit(50)


@Q("jon06_paired_weighted", sql("req", "ret", body=f"""with w as (select run_id, question_id, request_id, sum(score / rank) / sum(1.0 / rank) as w from req join ret using (request_id) group by 1, 2, 3),
 a as (select question_id, avg(w) as wa from w where run_id = '{A_RUN}' group by 1), b as (select question_id, avg(w) as wb from w where run_id = '{B_RUN}' group by 1), c as (select distinct question_id, min(received_at) over (partition by question_id) as first_seen from req)
 select question_id, round(wa, 6) as weighted_a, round(wb, 6) as weighted_b, first_seen from (select coalesce(a.question_id, b.question_id) as question_id, wa, wb from a full join b on a.question_id = b.question_id) left join c using (question_id)"""))
def jon06(spark, folder):
    w = requests(spark, folder).join(retrieval_results(spark, folder), "request_id").groupBy("run_id", "question_id", "request_id").agg(M.rank_weighted_mean_all(F.col("score"), F.col("rank")).alias("w"))
    side = lambda run, name: w.where(F.col("run_id") == run).groupBy("question_id").agg(r(F.avg("w")).alias(name))
    first = requests(spark, folder).groupBy("question_id").agg(F.min("received_at").alias("first_seen"))
    return side(A_RUN, "weighted_a").join(side(B_RUN, "weighted_b"), "question_id", "full").join(first, "question_id", "left")


@Q("jon07_capture_cost", sql("cap", "gen", body="select cap.request_id, run_id, count(*) as rows, sum(total_tokens)::bigint as tokens from cap join gen using (request_id) group by 1, 2"))
def jon07(spark, folder):
    return captures(spark, folder).join(generation_results(spark, folder), "request_id").groupBy("request_id", "run_id").agg(F.count("*").alias("rows"), F.sum("total_tokens").cast("bigint").alias("tokens"))


LABELS = [("answer_completeness", x) for x in ("complete", "partial", "incomplete")] + [("answer_relevance", x) for x in ("relevant", "partially_relevant", "irrelevant")] + [("groundedness", x) for x in ("grounded", "partially_grounded", "ungrounded")] + [("correct_refusal", x) for x in ("correct_refusal", "unnecessary_refusal", "non_refusal", "unclear")]
GRID = "grid as (select * from (values " + ", ".join(f"('{a}', '{b}')" for a, b in LABELS) + ") t(suite_name, label))"


def _label_grid(spark, folder):
    grid = spark.createDataFrame(LABELS, "suite_name string, label string")
    got = generation_results(spark, folder).where("label is not null")
    n = got.groupBy("suite_name", "label").agg(F.count("*").alias("n"))
    total = got.groupBy("suite_name").agg(F.count("*").alias("total"))
    rows = F.broadcast(grid).join(n, ["suite_name", "label"], "left").join(total, "suite_name", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select("suite_name", "label", zero("n").alias("n"), r(M.ratio(100.0 * zero("n"), zero("total")), 4).alias("percent"))


@Q("jon08_label_grid", sql("gen", body=f"with {GRID}, n as (select suite_name, label, count(*) as n from gen where label is not null group by 1, 2), t as (select suite_name, count(*) as total from gen where label is not null group by 1) select suite_name, label, coalesce(n, 0) as n, round(case when coalesce(total, 0) > 0 then 100.0 * coalesce(n, 0) / total else 0 end, 4) as percent from grid left join n using (suite_name, label) left join t using (suite_name)"))
def jon08(spark, folder):
    return _label_grid(spark, folder)


RET_LABELS = ["relevant", "partial", "irrelevant", "unclear"]


@Q("agg08_label_distribution", sql("ret", "req", body="with grid as (select run_id, label from (select distinct run_id from req) a, (select unnest(['relevant', 'partial', 'irrelevant', 'unclear']) as label) b), n as (select run_id, label, count(*) as n from req join ret using (request_id) group by 1, 2), t as (select run_id, sum(n) as total from n group by 1) select run_id, label, coalesce(n, 0) as n, round(case when total > 0 then 100.0 * coalesce(n, 0) / total else 0 end, 4) as percent from grid left join n using (run_id, label) left join t using (run_id)"))
def agg08(spark, folder):
    q = requests(spark, folder)
    grid = q.select("run_id").distinct().select("run_id", F.explode(F.array(*[F.lit(x) for x in RET_LABELS])).alias("label"))
    n = q.join(retrieval_results(spark, folder), "request_id").groupBy("run_id", "label").agg(F.count("*").alias("n"))
    total = n.groupBy("run_id").agg(F.sum("n").alias("total"))
    rows = grid.join(n, ["run_id", "label"], "left").join(total, "run_id", "left")
    count = F.coalesce("n", F.lit(0))
    return rows.select("run_id", "label", count.alias("n"), r(M.ratio(100.0 * count, F.coalesce("total", F.lit(0))), 4).alias("percent"))


@Q("jon09_requests_of_judged_runs", sql("cap", "gen", body="select request_id, epoch_us(received_at) as received_us from cap where request_id in (select request_id from gen where suite_name = 'groundedness' and score < 0.6)"))
def jon09(spark, folder):
    low = generation_results(spark, folder).where("suite_name = 'groundedness' and score < 0.6").select("request_id")
    return captures(spark, folder).join(low, "request_id", "left_semi").select("request_id", F.unix_micros("received_at").alias("received_us"))


@Q("jon10_chunk_lookup", sql("ret", body="select request_id, rank, p_name as chunk_text from ret join part on p_partkey = chunk_id"))
def jon10(spark, folder):
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("chunk_text"))
    return retrieval_results(spark, folder).join(parts, "chunk_id").select("request_id", "rank", "chunk_text")


NORM_SQL = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"


@Q("jon11_question_by_text", sql("cap", body=f"with q as (select {NORM_SQL.format('normalized_query')} as text, min(request_id) as question from cap where normalized_query is not null group by 1) select request_id, question from cap join q on q.text = {NORM_SQL.format('raw_query')}"))
def jon11(spark, folder):
    from ..functions.text import question_key

    c = captures(spark, folder)
    q = c.where("normalized_query is not null").groupBy(question_key(F.col("normalized_query")).alias("text")).agg(F.min("request_id").alias("question"))
    return c.withColumn("text", question_key(F.col("raw_query"))).join(q, "text").select("request_id", "question")


@Q("jon19_trace_join", sql("cap", "gen", body="""with a as (select trace_id, epoch_us(min(received_at)) as first_us from cap where trace_id is not null group by 1), b as (select trace_id, count(*) as n from gen where suite_name = 'answer_relevance' group by 1), c as (select trace_id, max(score)::double as best from gen group by 1)
 select a.trace_id, first_us, n, best from a join b using (trace_id) join c using (trace_id)"""))
def jon19(spark, folder):
    g = generation_results(spark, folder)
    a = captures(spark, folder).where("trace_id is not null").groupBy("trace_id").agg(F.unix_micros(F.min("received_at")).alias("first_us"))
    b = g.where("suite_name = 'answer_relevance'").groupBy("trace_id").agg(F.count("*").alias("n"))
    c = g.groupBy("trace_id").agg(F.max("score").cast("double").alias("best"))
    return a.join(b, "trace_id").join(c, "trace_id")


@Q("jon20_missing_suites", sql("cap", "gen", body=f"select request_id, suite_name from cap join (select unnest([{SUITE_LIST}]) as suite_name) s on true where (request_id, suite_name) not in (select (request_id, suite_name) from gen)"))
def jon20(spark, folder):
    need = captures(spark, folder).select("request_id", F.explode(F.array(*[F.lit(s) for s in SUITES])).alias("suite_name"))
    return need.join(generation_results(spark, folder), ["request_id", "suite_name"], "left_anti")


# aggregations -------------------------------------------------------------------------------------


@Q("agg02_chunk_depth", sql("ret", body="select round(avg(n), 6) as mean, min(n) as least, max(n) as most from (select count(*) as n from ret group by request_id)"))
def agg02(spark, folder):
    n = retrieval_results(spark, folder).groupBy("request_id").agg(F.count("*").alias("n"))
    return n.agg(r(F.avg("n")).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"))


WIDE = """wide as (select request_id, max(score) filter (suite_name = 'answer_completeness')::double as completeness, max(score) filter (suite_name = 'groundedness')::double as groundedness, max(score) filter (suite_name = 'answer_relevance')::double as relevance, max(label) filter (suite_name = 'correct_refusal') as refusal_label from gen group by 1),
 ranks as (select l_orderkey as n, min(rank) filter (score = 1.0) as first_rank from (select request_id as l_orderkey, rank, score from ret) group by 1),
 num as (select request_id, row_number() over (order by request_id) as n from wide), both_ as (select wide.*, first_rank from wide join num using (request_id) left join ranks using (n))"""


def _wide(spark, folder):
    from ..operators.ordering import global_row_number

    g = generation_results(spark, folder)
    pick = lambda s, c: F.max(F.when(F.col("suite_name") == s, F.col(c)))
    wide = g.groupBy("request_id").agg(pick("answer_completeness", "score").cast("double").alias("completeness"), pick("groundedness", "score").cast("double").alias("groundedness"), pick("answer_relevance", "score").cast("double").alias("relevance"), pick("correct_refusal", "label").alias("refusal_label"))
    ranks = retrieval_results(spark, folder).groupBy(F.col("request_id").alias("n")).agg(F.min(F.when(F.col("score") == 1.0, F.col("rank"))).alias("first_rank"))
    return global_row_number(wide, ["request_id"], "n").withColumn("n", F.col("n") + 1).join(ranks, "n", "left")


@Q("agg03_conditional_means", sql("gen", "ret", body=f"""with {WIDE} select round(avg(completeness) filter (first_rank = 1), 6) as completeness_first, round(avg(completeness) filter (first_rank is distinct from 1), 6) as completeness_not_first,
 round(avg(case when groundedness < 1 then 1.0 else 0.0 end) filter (first_rank is distinct from 1), 6) as hallucination_rate, round(avg(case when completeness = 1 and groundedness = 1 then 1.0 else 0.0 end), 6) as success_rate, round(avg(relevance) filter (first_rank <= 3), 6) as relevance_top3 from both_"""))
def agg03(spark, folder):
    w = _wide(spark, folder)
    first = F.col("first_rank").eqNullSafe(F.lit(1))
    miss = F.when(F.col("groundedness") < 1, 1.0).otherwise(0.0)
    good = F.when((F.col("completeness") == 1) & (F.col("groundedness") == 1), 1.0).otherwise(0.0)
    return w.agg(r(F.avg(F.when(first, F.col("completeness")))).alias("completeness_first"), r(F.avg(F.when(~first, F.col("completeness")))).alias("completeness_not_first"), r(F.avg(F.when(~first, miss))).alias("hallucination_rate"), r(F.avg(good)).alias("success_rate"), r(F.avg(F.when(F.col("first_rank") <= 3, F.col("relevance")))).alias("relevance_top3"))


@Q("agg04_token_totals", sql("cap", body="select runtime_run_id, coalesce(sum(prompt_tokens), 0)::bigint as prompt_tokens, coalesce(sum(completion_tokens), 0)::bigint as completion_tokens, coalesce(sum(total_tokens), 0)::bigint as total_tokens from cap group by 1"))
def agg04(spark, folder):
    return captures(spark, folder).groupBy("runtime_run_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")])


COST = "round((prompt_tokens * 0.05 + completion_tokens * 0.2) / 1e6, 8)"


def _costed(spark, folder):
    cost = F.round((F.col("prompt_tokens") * F.lit(0.05) + F.col("completion_tokens") * F.lit(0.2)) / F.lit(1e6), 8)
    return judge_calls(spark, folder).withColumn("cost", cost)


@Q("agg05_usage_by_stage", sql("calls", body=f"with c as (select *, {COST} as cost from calls) select coalesce(stage, 'total') as stage, count(*) as calls, sum(prompt_tokens)::bigint as prompt_tokens, sum(completion_tokens)::bigint as completion_tokens, round(sum(cost), 6) as cost from c group by rollup(stage)"))
def agg05(spark, folder):
    return _costed(spark, folder).rollup("stage").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), r(F.sum("cost")).alias("cost")).withColumn("stage", F.coalesce("stage", F.lit("total")))


@Q("agg36_call_cost", sql("calls", body="select request_id, stage, count(*) as calls, sum(cast(round(cast(prompt_tokens * 50000 + completion_tokens * 200000 as decimal(20, 0)) / 10000, 0) as bigint))::bigint as micro from calls group by 1, 2"))
def agg36(spark, folder):
    micro = F.round((F.col("prompt_tokens") * 50000 + F.col("completion_tokens") * 200000).cast("decimal(20,0)") / 10000, 0).cast("bigint")
    return judge_calls(spark, folder).groupBy("request_id", "stage").agg(F.count("*").alias("calls"), F.sum(micro).alias("micro"))


@Q("agg37_generation_cost", sql("cap", body="select request_id, round(prompt_tokens * 0.05 / 1e6 + completion_tokens * 0.2 / 1e6, 10) as cost, cast(round(prompt_tokens * 0.05 + completion_tokens * 0.2, 0) as bigint) as micro_usd from cap where prompt_tokens is not null"))
def agg37(spark, folder):
    p, c = F.col("prompt_tokens"), F.col("completion_tokens")
    return captures(spark, folder).where("prompt_tokens is not null").select("request_id", F.round(p * F.lit(0.05) / F.lit(1e6) + c * F.lit(0.2) / F.lit(1e6), 10).alias("cost"), F.round(p * F.lit(0.05) + c * F.lit(0.2), 0).cast("bigint").alias("micro_usd"))


@Q("agg06_metric_table", sql("gen", body="select suite_name, count(score) as n, round(avg(score::double), 6) as mean, quantile_disc(score::double, 0.5) as p50, quantile_disc(score::double, 0.9) as p90 from gen group by 1"))
def agg06(spark, folder):
    s = generation_results(spark, folder).withColumn("s", F.col("score").cast("double"))
    return s.groupBy("suite_name").agg(F.count("s").alias("n"), r(F.avg("s")).alias("mean"), M.nearest_rank("s", 0.5).alias("p50"), M.nearest_rank("s", 0.9).alias("p90"))


@Q("agg07_nearest_rank", "select l_returnflag, quantile_disc(l_extendedprice, 0.5) as p50, quantile_disc(l_extendedprice, 0.9) as p90, quantile_disc(l_extendedprice, 0.99) as p99 from lineitem group by 1")
def agg07(spark, folder):
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(*[M.nearest_rank("l_extendedprice", p).alias(f"p{int(p * 100)}") for p in (0.5, 0.9, 0.99)])


@Q("agg09_weighted_mean", sql("ret", body="with s as (select request_id, rank, case when chunk_id % 10 <> 0 then score end as score from ret) select request_id, round(sum(score / rank) / sum(case when score is not null then 1.0 / rank end), 6) as weighted from s group by 1"))
def agg09(spark, folder):
    s = retrieval_results(spark, folder).withColumn("score", F.when(F.col("chunk_id") % 10 != 0, F.col("score")))
    return s.groupBy("request_id").agg(r(M.rank_weighted_mean(F.col("score"), F.col("rank"))).alias("weighted"))


@Q("agg10_weighted_mean_of_run", sql("ret", "req", body="with w as (select request_id, sum(score / rank) / sum(1.0 / rank) as w from ret group by 1) select run_id, round(avg(w), 6) as weighted from w join req using (request_id) group by 1"))
def agg10(spark, folder):
    w = retrieval_results(spark, folder).groupBy("request_id").agg(M.rank_weighted_mean(F.col("score"), F.col("rank")).alias("w"))
    return w.join(requests(spark, folder), "request_id").groupBy("run_id").agg(r(F.avg("w")).alias("weighted"))


@Q("agg11_weighted_mean_all_rows", sql("ret", body="with s as (select request_id, rank, case when chunk_id % 10 <> 0 then score end as score from ret) select request_id, round(sum(score / rank) / sum(1.0 / rank), 6) as weighted from s group by 1"))
def agg11(spark, folder):
    s = retrieval_results(spark, folder).withColumn("score", F.when(F.col("chunk_id") % 10 != 0, F.col("score")))
    return s.groupBy("request_id").agg(r(M.rank_weighted_mean_all(F.col("score"), F.col("rank"))).alias("weighted"))


@Q("mth06_reranked_weighted_mean", sql("ret", body="with s as (select request_id, score, row_number() over (partition by request_id order by rank) as k from ret where chunk_id % 10 <> 0) select request_id, round(sum(score / k) / sum(1.0 / k), 6) as weighted from s group by 1"))
def mth06(spark, folder):
    s = retrieval_results(spark, folder).withColumn("score", F.when(F.col("chunk_id") % 10 != 0, F.col("score")))
    return M.reranked_weighted_mean(s, "request_id", "score", "rank").select("request_id", r(F.col("weighted")).alias("weighted"))


@Q("agg12_request_summary", sql("ret", body="select request_id, round(avg(score), 6) as mean, round(avg(score) filter (rank <= 4), 6) as selected_mean, count(*) filter (score = 1.0) as relevant, count(*) filter (rank <= 4) as selected, round(avg(score), 6) as topk_mean from ret group by 1"))
def agg12(spark, folder):
    picked = F.col("rank") <= 4
    return retrieval_results(spark, folder).groupBy("request_id").agg(r(F.avg("score")).alias("mean"), r(F.avg(F.when(picked, F.col("score")))).alias("selected_mean"), F.count_if(F.col("score") == 1.0).alias("relevant"), F.count_if(picked).alias("selected"), r(F.avg("score")).alias("topk_mean"))


@Q("agg13_suite_pivot", sql("gen", body="select request_id, " + ", ".join(f"max(score) filter (suite_name = '{s}')::double as {s}_score, max(label) filter (suite_name = '{s}') as {s}_label" for s in SUITES) + " from gen group by 1"))
def agg13(spark, folder):
    g = generation_results(spark, folder).groupBy("request_id").pivot("suite_name", SUITES).agg(F.max("score").cast("double").alias("score"), F.max("label").alias("label"))
    return g


@Q("agg14_label_unpivot", sql("gen", body="select request_id, suite_name, label from (" + " union all ".join(f"select request_id, '{s}' as suite_name, max(label) filter (suite_name = '{s}') as label from gen group by 1" for s in SUITES) + ")"))
def agg14(spark, folder):
    wide = generation_results(spark, folder).groupBy("request_id").pivot("suite_name", SUITES).agg(F.max("label"))
    return wide.unpivot("request_id", SUITES, "suite_name", "label")


@Q("agg15_context_loss", sql("ret", body="""with a as (select request_id, count(*) filter (score > 0) as all_, count(*) filter (score > 0 and rank <= 6) / nullif(count(*) filter (score > 0), 0) as retrieval, count(*) filter (score > 0 and rank <= 2) / nullif(count(*) filter (score > 0), 0) as context from ret group by 1)
 select request_id, round(retrieval - context, 6) as context_loss from a"""))
def agg15(spark, folder):
    rel = F.col("score") > 0
    share = lambda k: F.count_if(rel & (F.col("rank") <= k)) / F.nullif(F.count_if(rel), F.lit(0))
    return retrieval_results(spark, folder).groupBy("request_id").agg(r(share(6) - share(2)).alias("context_loss"))


TAGS = "tagged as (select request_id, question_id, run_id, unnest(case question_id % 4 when 0 then ['causal', 'contrast'] when 1 then ['contrast'] when 2 then ['tradeoff', 'failure'] else ['failure'] end) as tag from req)"


@Q("agg16_tag_rollup", sql("req", "ret", body=f"""with {TAGS}, e as (select tag, count(distinct question_id) as expected from tagged group by 1), s as (select request_id, avg(score) as score from ret group by 1)
 select run_id, tag, expected, count(distinct case when score is not null then question_id end) as observed, count(score) as requests, round(avg(score), 6) as mean, expected > count(distinct case when score is not null then question_id end) as partial from tagged join e using (tag) left join s using (request_id) group by 1, 2, 3"""))
def agg16(spark, folder):
    tags = F.when(F.col("question_id") % 4 == 0, F.array(F.lit("causal"), F.lit("contrast"))).when(F.col("question_id") % 4 == 1, F.array(F.lit("contrast"))).when(F.col("question_id") % 4 == 2, F.array(F.lit("tradeoff"), F.lit("failure"))).otherwise(F.array(F.lit("failure")))
    tagged = requests(spark, folder).select("request_id", "question_id", "run_id", F.explode(tags).alias("tag"))
    expected = tagged.groupBy("tag").agg(F.count_distinct("question_id").alias("expected"))
    score = retrieval_results(spark, folder).groupBy("request_id").agg(F.avg("score").alias("score"))
    out = tagged.join(score, "request_id", "left").groupBy("run_id", "tag").agg(F.count_distinct(F.when(F.col("score").isNotNull(), F.col("question_id"))).alias("observed"), F.count("score").alias("requests"), r(F.avg("score")).alias("mean"))
    return out.join(F.broadcast(expected), "tag").select("run_id", "tag", "expected", "observed", "requests", "mean", (F.col("expected") > F.col("observed")).alias("partial"))


@Q("agg17_suite_counts", sql("gen", body="select suite_name, count(*) as n, count(distinct request_id) as requests, round(avg(score::double), 4) as mean from gen group by 1"))
def agg17(spark, folder):
    return generation_results(spark, folder).groupBy("suite_name").agg(F.count("*").alias("n"), F.count_distinct("request_id").alias("requests"), F.round(F.avg(F.col("score").cast("double")), 4).alias("mean"))


STATE = "state as (select o_orderkey as request_id, o_orderdate as received_at, case o_orderkey % 3 when 0 then 'judge_generation' when 1 then 'judge_retrieval' else 'build_request_summary' end as stage, case o_orderstatus when 'F' then 'completed' when 'O' then 'pending' else 'failed' end as status from orders)"


def _state(spark, folder):
    o = table(spark, folder, "orders")
    stage = F.when(F.col("o_orderkey") % 3 == 0, "judge_generation").when(F.col("o_orderkey") % 3 == 1, "judge_retrieval").otherwise("build_request_summary")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
    return o.select(F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").alias("received_at"), stage.alias("stage"), status.alias("status"))


@Q("agg18_state_counts", f"with {STATE} select stage, status, count(*) as n from state group by grouping sets ((stage, status), (stage), ())")
def agg18(spark, folder):
    return _state(spark, folder).groupingSets([["stage", "status"], ["stage"], []], "stage", "status").agg(F.count("*").alias("n"))


@Q("agg19_run_status", sql("req", body=f"with {STATE} select run_id, case when count(*) filter (status = 'failed') > 2450 then 'failed' when count(*) filter (status <> 'completed') = 0 then 'completed' else 'running' end as status from state join req using (request_id) group by 1"))
def agg19(spark, folder):
    rows = _state(spark, folder).join(requests(spark, folder).select("request_id", "run_id"), "request_id")
    status = F.when(F.count_if(F.col("status") == "failed") > 2450, "failed").when(F.count_if(F.col("status") != "completed") == 0, "completed").otherwise("running")
    return rows.groupBy("run_id").agg(status.alias("status"))


@Q("agg20_scope_diagnostics", sql("req", body=f"with s as (select request_id from req where run_id = '{A_RUN}'), t as (select count(*) as n from s) select retriever_kind, count(*) as covered, round(count(*) / (select n from t), 6) as coverage from req where request_id in (select request_id from s) group by 1 having count(*) > 5"))
def agg20(spark, folder):
    q = requests(spark, folder)
    scope = q.where(F.col("run_id") == A_RUN).select("request_id")
    n = scope.agg(F.count("*").alias("n"))
    got = q.join(scope, "request_id", "left_semi").groupBy("retriever_kind").agg(F.count("*").alias("covered")).where("covered > 5")
    return got.crossJoin(F.broadcast(n)).select("retriever_kind", "covered", r(F.col("covered") / F.col("n")).alias("coverage"))


@Q("agg21_run_summary_counts", sql("cap", "gen", body="select (select count(*) from cap) as captures, (select count(*) from gen) as judgements, (select count(distinct run_id) from gen) as runs, (select count(distinct request_id) from gen) as judged_requests"))
def agg21(spark, folder):
    c = captures(spark, folder).agg(F.count("*").alias("captures"))
    g = generation_results(spark, folder).agg(F.count("*").alias("judgements"), F.count_distinct("run_id").alias("runs"), F.count_distinct("request_id").alias("judged_requests"))
    return c.crossJoin(g)


@Q("agg32_relevance_summary", sql("ret", body="""with p as (select request_id, avg(score) as mean_topk, max(score) filter (rank = 1) as top1, max(score) filter (rank = 2) as top2, avg(case when score = 0 then 1.0 else 0 end) filter (rank > 2) as tail_noise from ret group by 1)
 select round(avg(mean_topk), 6) as mean, round(quantile_cont(mean_topk, 0.5), 6) as median, round(avg((top1 = 1.0)::int), 6) as top1_rate, round(avg((top2 >= 0.5)::int), 6) as top2_useful_rate, round(avg(tail_noise), 6) as tail_noise_rate from p"""))
def agg32(spark, folder):
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("score")))
    p = retrieval_results(spark, folder).groupBy("request_id").agg(F.avg("score").alias("m"), at(1).alias("t1"), at(2).alias("t2"), F.avg(F.when(F.col("rank") > 2, (F.col("score") == 0).cast("double"))).alias("noise"))
    return p.agg(r(F.avg("m")).alias("mean"), r(F.percentile("m", 0.5)).alias("median"), r(F.avg((F.col("t1") == 1.0).cast("int"))).alias("top1_rate"), r(F.avg((F.col("t2") >= 0.5).cast("int"))).alias("top2_useful_rate"), r(F.avg("noise")).alias("tail_noise_rate"))


@Q("agg33_value_counts", sql("ret", body="select label, score, count(*) as n from ret group by 1, 2"))
def agg33(spark, folder):
    return retrieval_results(spark, folder).groupBy("label", "score").agg(F.count("*").alias("n"))


@Q("agg35_score_bounds", sql("ret", body="select request_id, rank, min(retrieval_score) over (partition by request_id) as low, max(retrieval_score) over (partition by request_id) as high from ret"))
def agg35(spark, folder):
    w = Window.partitionBy("request_id")
    return retrieval_results(spark, folder).select("request_id", "rank", F.min("retrieval_score").over(w).alias("low"), F.max("retrieval_score").over(w).alias("high"))


@Q("agg38_score_telemetry", sql("ret", body="select request_id, count(*) as results, max(retrieval_score) filter (rank = 1) as top1, round(avg(retrieval_score) filter (rank <= 4), 6) as topk_mean from ret group by 1"))
def agg38(spark, folder):
    return retrieval_results(spark, folder).groupBy("request_id").agg(F.count("*").alias("results"), F.min_by("retrieval_score", "rank").alias("top1"), r(F.avg(F.when(F.col("rank") <= 4, F.col("retrieval_score")))).alias("topk_mean"))


@Q("agg39_run_list", sql("req", body="select run_id, min(received_at) as first_seen from req group by 1 order by 2 desc"))
def agg39(spark, folder):
    return requests(spark, folder).groupBy("run_id").agg(F.min("received_at").alias("first_seen")).orderBy(F.desc("first_seen"))


@Q("agg40_quality_attributes", sql("ret", body="select request_id, min(rank) filter (score = 1.0)::bigint as first_strict, min(rank) filter (score > 0)::bigint as first_soft, count(*) filter (score > 0 and rank <= 6) - count(*) filter (score > 0 and rank <= 2) as lost_relevant from ret group by 1"))
def agg40(spark, folder):
    s, k = F.col("score"), F.col("rank")
    return retrieval_results(spark, folder).groupBy("request_id").agg(F.min(F.when(s == 1.0, k)).cast("bigint").alias("first_strict"), F.min(F.when(s > 0, k)).cast("bigint").alias("first_soft"), (F.count_if((s > 0) & (k <= 6)) - F.count_if((s > 0) & (k <= 2))).alias("lost_relevant"))


@Q("agg42_run_coverage", sql("req", "ret", body="select run_id, count(*) as scope, count(*) filter (n > 0) as judged, round(count(*) filter (n > 0) / count(*), 6) as coverage from req left join (select request_id, count(*) as n from ret group by 1) using (request_id) group by 1"))
def agg42(spark, folder):
    n = retrieval_results(spark, folder).groupBy("request_id").agg(F.count("*").alias("n"))
    return requests(spark, folder).join(n, "request_id", "left").groupBy("run_id").agg(F.count("*").alias("scope"), F.count_if(F.col("n") > 0).alias("judged"), r(F.count_if(F.col("n") > 0) / F.count("*")).alias("coverage"))


# comparisons --------------------------------------------------------------------------------------

METRIC_NAMES = ["mean_score", "top1_score", "mean_retrieval_score", "relevant_share", "requests"]


def _run_metrics(spark, folder, run):
    rows = requests(spark, folder).where(F.col("run_id") == run).join(retrieval_results(spark, folder), "request_id")
    wide = rows.agg(F.avg("score").alias("mean_score"), F.avg(F.when(F.col("rank") == 1, F.col("score"))).alias("top1_score"), F.avg("retrieval_score").alias("mean_retrieval_score"), F.avg((F.col("score") > 0).cast("double")).alias("relevant_share"), F.count_distinct("request_id").cast("double").alias("requests"))
    return wide.unpivot([], METRIC_NAMES, "metric", "value")


RUN_SQL = "(select avg(score) as mean_score, avg(score) filter (rank = 1) as top1_score, avg(retrieval_score) as mean_retrieval_score, avg((score > 0)::int) as relevant_share, count(distinct request_id)::double as requests from req join ret using (request_id) where run_id = '{}')"


@Q("cmp01_compare_metrics", sql("req", "ret", body=f"with a as (unpivot {RUN_SQL.format(A_RUN)} on {', '.join(METRIC_NAMES)} into name metric value va), b as (unpivot {RUN_SQL.format(B_RUN)} on {', '.join(METRIC_NAMES)} into name metric value vb) select metric, round(va, 4) as baseline, round(vb, 4) as candidate, round(vb - va, 4) as delta from a join b using (metric)"))
def cmp01(spark, folder):
    a, b = _run_metrics(spark, folder, A_RUN), _run_metrics(spark, folder, B_RUN).withColumnRenamed("value", "vb")
    return a.join(b, "metric").select("metric", F.round("value", 4).alias("baseline"), F.round("vb", 4).alias("candidate"), F.round(F.col("vb") - F.col("value"), 4).alias("delta"))


CONFIG = ["retriever_kind", "retriever_version", "embedding_model", "generation_model", "reranker_kind", "requests"]


@Q("cmp02_compare_config", sql("cap", body=f"""with p as (select min(runtime_run_id) as a, max(runtime_run_id) as b from cap),
 f as (select *, count(*) over (partition by runtime_run_id)::varchar as requests, row_number() over (partition by runtime_run_id order by received_at, request_id) as rn from cap where runtime_run_id is not null),
 w as (select runtime_run_id, {', '.join(f"coalesce({c}, 'n/a') as {c}" for c in CONFIG)} from f where rn = 1),
 u as (unpivot w on {', '.join(CONFIG)} into name field value v)
 select field, max(v) filter (runtime_run_id = (select a from p)) as baseline, max(v) filter (runtime_run_id = (select b from p)) as candidate from u where runtime_run_id in ((select a from p), (select b from p)) group by 1"""))
def cmp02(spark, folder):
    c = captures(spark, folder).where("runtime_run_id is not null")
    ends = c.agg(F.min("runtime_run_id").alias("a"), F.max("runtime_run_id").alias("b"))
    first = Window.partitionBy("runtime_run_id").orderBy("received_at", "request_id")
    own = c.join(F.broadcast(ends), (F.col("runtime_run_id") == F.col("a")) | (F.col("runtime_run_id") == F.col("b")))
    one = own.withColumn("requests", F.count("*").over(Window.partitionBy("runtime_run_id")).cast("string")).withColumn("rn", F.row_number().over(first)).where("rn = 1")
    wide = one.select("runtime_run_id", "a", "b", *[F.coalesce(F.col(x), F.lit("n/a")).alias(x) for x in CONFIG])
    long = wide.unpivot(["runtime_run_id", "a", "b"], CONFIG, "field", "v")
    return long.groupBy("field").agg(F.max(F.when(F.col("runtime_run_id") == F.col("a"), F.col("v"))).alias("baseline"), F.max(F.when(F.col("runtime_run_id") == F.col("b"), F.col("v"))).alias("candidate"))


@Q("cmp03_compare_labels", sql("req", "ret", body=f"with c as (select label, run_id, count(*) as n from req join ret using (request_id) where run_id in ('{A_RUN}', '{B_RUN}') group by 1, 2) select label, coalesce(max(n) filter (run_id = '{A_RUN}'), 0) as n_a, coalesce(max(n) filter (run_id = '{B_RUN}'), 0) as n_b from c group by 1"))
def cmp03(spark, folder):
    rows = requests(spark, folder).join(retrieval_results(spark, folder), "request_id")
    return rows.groupBy("label").agg(F.count_if(F.col("run_id") == A_RUN).alias("n_a"), F.count_if(F.col("run_id") == B_RUN).alias("n_b")).where("n_a + n_b > 0")


@Q("cmp04_compare_usage", sql("req", "calls", body=f"""with c as (select run_id, stage, {COST} as cost, prompt_tokens, completion_tokens from req join calls using (request_id) where run_id in ('{A_RUN}', '{B_RUN}')), g as (select run_id, coalesce(stage, 'judge total') as part, sum(prompt_tokens)::double as prompt_tokens, sum(completion_tokens)::double as completion_tokens, round(sum(cost), 6) as cost, count(*)::double as calls from c group by grouping sets ((run_id, stage), (run_id))),
 u as (unpivot g on prompt_tokens, completion_tokens, cost, calls into name field value v) select part, field, coalesce(max(v) filter (run_id = '{A_RUN}'), 0) as baseline, coalesce(max(v) filter (run_id = '{B_RUN}'), 0) as candidate, round(coalesce(max(v) filter (run_id = '{B_RUN}'), 0) - coalesce(max(v) filter (run_id = '{A_RUN}'), 0), 6) as delta from u group by 1, 2"""))
def cmp04(spark, folder):
    c = _costed(spark, folder).join(requests(spark, folder).where(F.col("run_id").isin(A_RUN, B_RUN)), "request_id")
    g = c.groupingSets([["run_id", "stage"], ["run_id"]], "run_id", "stage").agg(F.sum("prompt_tokens").cast("double").alias("prompt_tokens"), F.sum("completion_tokens").cast("double").alias("completion_tokens"), r(F.sum("cost")).alias("cost"), F.count("*").cast("double").alias("calls")).withColumn("part", F.coalesce("stage", F.lit("judge total")))
    u = g.unpivot(["run_id", "part"], ["prompt_tokens", "completion_tokens", "cost", "calls"], "field", "v")
    side = lambda run: F.coalesce(F.max(F.when(F.col("run_id") == run, F.col("v"))), F.lit(0.0))
    return u.groupBy("part", "field").agg(side(A_RUN).alias("baseline"), side(B_RUN).alias("candidate"), r(side(B_RUN) - side(A_RUN)).alias("delta"))


SCOPES = f"a as (select distinct question_id from req where run_id = '{A_RUN}'), b as (select distinct question_id from req where run_id = '{B_RUN}')"


def _scopes(spark, folder):
    q = requests(spark, folder)
    return [q.where(F.col("run_id") == run).select("question_id").distinct() for run in (A_RUN, B_RUN)]


@Q("cmp05_compare_scopes", sql("req", body=f"with {SCOPES} select (select count(*) from (select * from a intersect select * from b)) as shared, (select count(*) from (select * from a except select * from b)) as only_baseline, (select count(*) from (select * from b except select * from a)) as only_candidate"))
def cmp05(spark, folder):
    a, b = _scopes(spark, folder)
    both = a.withColumn("x", F.lit(1)).join(b.withColumn("y", F.lit(1)), "question_id", "full")
    return both.agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("shared"), F.count_if(F.col("y").isNull()).alias("only_baseline"), F.count_if(F.col("x").isNull()).alias("only_candidate"))


@Q("cmp06_request_across_runs", sql("req", body="select question_id, run_id, request_id, received_at from req where question_id in (1, 2, 4, 5, 7, 8, 10)"))
def cmp06(spark, folder):
    return requests(spark, folder).where(F.col("question_id").isin(1, 2, 4, 5, 7, 8, 10)).select("question_id", "run_id", "request_id", "received_at").orderBy("question_id", "run_id", "received_at")


@Q("cmp08_scope_matrix", sql("req", "ret", body=f"with scope as (select request_id from req where run_id = '{A_RUN}'), s as (select request_id, round(avg(score), 6) as score from ret group by 1) select request_id, score, score is null as missing from scope left join s using (request_id)"))
def cmp08(spark, folder):
    scope = requests(spark, folder).where(F.col("run_id") == A_RUN).select("request_id")
    s = retrieval_results(spark, folder).groupBy("request_id").agg(r(F.avg("score")).alias("score"))
    return scope.join(s, "request_id", "left").select("request_id", "score", F.col("score").isNull().alias("missing"))


@Q("cmp09_usage_overview", sql("cap", "calls", body=f"""with c as (select stage, prompt_tokens, completion_tokens from calls), x as (select 'runtime' as part, coalesce(sum(prompt_tokens), 0)::bigint as prompt_tokens, coalesce(sum(completion_tokens), 0)::bigint as completion_tokens from cap union all select stage, sum(prompt_tokens)::bigint, sum(completion_tokens)::bigint from c group by 1 union all select 'judge total', sum(prompt_tokens)::bigint, sum(completion_tokens)::bigint from c)
 select * from x union all select 'run total', sum(prompt_tokens)::bigint, sum(completion_tokens)::bigint from x where part in ('runtime', 'judge total')"""))
def cmp09(spark, folder):
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("prompt_tokens", "completion_tokens")]
    runtime = captures(spark, folder).agg(*sums).withColumn("part", F.lit("runtime"))
    judges = judge_calls(spark, folder).rollup("stage").agg(*sums).select(*["prompt_tokens", "completion_tokens"], F.coalesce("stage", F.lit("judge total")).alias("part"))
    rows = runtime.unionByName(judges)
    return rows.unionByName(rows.where("part in ('runtime', 'judge total')").agg(*sums).withColumn("part", F.lit("run total")))


@Q("cmp10_runs_in_range", sql("cap", body="select runtime_run_id, count(*) as requests, epoch_us(min(received_at)) as first_us, epoch_us(max(received_at)) as last_us from cap where received_at >= (select min(received_at) + interval 1 day from cap) group by 1"))
def cmp10(spark, folder):
    c = captures(spark, folder)
    start = c.agg((F.min("received_at") + F.expr("interval 1 day")).alias("start"))
    return c.join(F.broadcast(start), F.col("received_at") >= F.col("start")).groupBy("runtime_run_id").agg(F.count("*").alias("requests"), F.unix_micros(F.min("received_at")).alias("first_us"), F.unix_micros(F.max("received_at")).alias("last_us"))


@Q("cmp11_request_bundle", sql("cap", "gen", body="with g as (select request_id, list(suite_name || '=' || coalesce(label, '?') order by suite_name, run_id) as judged from gen group by 1) select cap.request_id, raw_query, coalesce(judged, []) as judged, len(coalesce(judged, [])) as n from cap left join g using (request_id)"))
def cmp11(spark, folder):
    g = generation_results(spark, folder).groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("suite_name", "run_id", "label"))), lambda x: F.concat(x["suite_name"], F.lit("="), F.coalesce(x["label"], F.lit("?")))).alias("judged"))
    judged = F.coalesce("judged", F.array().cast("array<string>"))
    return captures(spark, folder).join(g, "request_id", "left").select("request_id", "raw_query", judged.alias("judged"), F.size(judged).alias("n"))


# sets ---------------------------------------------------------------------------------------------


@Q("set01_union_of_ids", "select l_orderkey as id from lineitem where l_quantity > 40 union select o_orderkey from orders where o_orderstatus = 'P'")
def set01(spark, folder):
    a = table(spark, folder, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("id"))
    return a.union(table(spark, folder, "orders").where("o_orderstatus = 'P'").select("o_orderkey")).distinct()


@Q("set02_detail_and_total", sql("calls", body="select stage, count(*) as calls from calls group by 1 union all select 'total', count(*) from calls"))
def set02(spark, folder):
    n = judge_calls(spark, folder).groupBy("stage").agg(F.count("*").alias("calls"))
    return n.unionByName(n.agg(F.sum("calls").alias("calls")).withColumn("stage", F.lit("total")))


@Q("set03_scope_intersection", sql("req", body=f"with {SCOPES} select question_id from a intersect select question_id from b"))
def set03(spark, folder):
    a, b = _scopes(spark, folder)
    return a.intersect(b)


@Q("set03_scope_difference", sql("req", body=f"with {SCOPES} select question_id from a except select question_id from b"))
def set03d(spark, folder):
    a, b = _scopes(spark, folder)
    return a.subtract(b)


@Q("set04_missing_questions", sql("req", body="select run_id, question_id from (select distinct run_id from req) a, (select distinct question_id from req) b except select run_id, question_id from req"))
def set04(spark, folder):
    q = requests(spark, folder).select("run_id", "question_id").distinct()
    runs = q.select("run_id").distinct().agg(F.collect_set("run_id").alias("runs"))  # a run is a handful of rows
    wanted = q.select("question_id").distinct().join(F.broadcast(runs)).select("question_id", F.explode("runs").alias("run_id"))
    return wanted.join(q, ["run_id", "question_id"], "left_anti").select("run_id", "question_id")


@Q("set06_strict_in_soft", sql("ret", body="select request_id, count(*) filter (score = 1.0 and score < 0.5) = 0 as subset from ret group by 1"))
def set06(spark, folder):
    pick = lambda c: F.collect_set(F.when(c, F.col("chunk_id")))
    return retrieval_results(spark, folder).groupBy("request_id").agg((F.size(F.array_except(pick(F.col("score") == 1.0), pick(F.col("score") >= 0.5))) == 0).alias("subset"))


@Q("set07_judged_equals_captured", sql("ret", body="with a as (select request_id, list_sort(list(distinct chunk_id)) as x from ret group by 1), b as (select request_id, list_sort(list(distinct chunk_id)) as y from ret where label <> 'irrelevant' group by 1) select request_id, x = coalesce(y, []) as same from a left join b using (request_id)"))
def set07(spark, folder):
    rows = retrieval_results(spark, folder).groupBy("request_id").agg(F.collect_set("chunk_id").alias("x"), F.collect_set(F.when(F.col("label") != "irrelevant", F.col("chunk_id"))).alias("y"))
    return rows.select("request_id", ((F.size(F.array_except("x", "y")) == 0) & (F.size(F.array_except("y", "x")) == 0)).alias("same"))


# windows and top lists ----------------------------------------------------------------------------


@Q("win13_rank_assignment", sql("cap", body="select request_id, cast(i as int) as rank, w as word from (select request_id, unnest(string_split(normalized_query, ' ')) as w, generate_subscripts(string_split(normalized_query, ' '), 1) as i from cap where normalized_query is not null)"))
def win13(spark, folder):
    c = captures(spark, folder).where("normalized_query is not null")
    return c.select("request_id", F.posexplode(F.split("normalized_query", " ")).alias("pos", "word")).select("request_id", (F.col("pos") + 1).alias("rank"), "word")


@Q("win14_count_over_run", sql("req", body="select request_id, count(*) over (partition by run_id) as in_run from req"))
def win14(spark, folder):
    return requests(spark, folder).select("request_id", F.count("*").over(Window.partitionBy("run_id")).alias("in_run"))


@Q("win15_first_of_run", sql("req", body="select distinct on (run_id) run_id, request_id, received_at from req order by run_id, received_at, request_id"))
def win15(spark, folder):
    return requests(spark, folder).groupBy("run_id").agg(F.min_by(F.struct("request_id", "received_at"), F.struct("received_at", "request_id")).alias("f")).select("run_id", "f.*")


@Q("win20_first_and_last_span", "select user_id, min_by(event_id, (ts, event_id)) as first_event, max_by(event_id, (ts, event_id)) as last_event from events group by 1")
def win20(spark, folder):
    at = F.struct("ts", "event_id")
    return table(spark, folder, "events").groupBy("user_id").agg(F.min_by("event_id", at).alias("first_event"), F.max_by("event_id", at).alias("last_event"))


@Q("top08_next_work_item", f"with {STATE} select stage, min_by(request_id, (received_at, request_id)) as request_id from state where status <> 'completed' group by 1")
def top08(spark, folder):
    return _state(spark, folder).where("status <> 'completed'").groupBy("stage").agg(F.min_by("request_id", F.struct("received_at", "request_id")).alias("request_id"))


@Q("top09_worst_per_suite", sql("gen", body="select suite_name, request_id, score::double as score, cast(rn as int) as rn from (select suite_name, request_id, score, row_number() over (partition by suite_name order by score, request_id, run_id) as rn from gen where score is not null) where rn <= 5"))
def top09(spark, folder):
    w = Window.partitionBy("suite_name").orderBy("score", "request_id", "run_id")
    g = generation_results(spark, folder).where("score is not null").withColumn("rn", F.row_number().over(w)).where("rn <= 5")
    return g.select("suite_name", "request_id", F.col("score").cast("double").alias("score"), "rn")


@Q("top10_recent_captures", sql("cap", body="select request_id, epoch_us(received_at) as received_us from cap order by received_at desc, request_id limit 20"))
def top10(spark, folder):
    return captures(spark, folder).orderBy(F.desc("received_at"), "request_id").limit(20).select("request_id", F.unix_micros("received_at").alias("received_us"))


@Q("top11_incomplete_requests", f"with {STATE} select request_id, stage, status from state where status <> 'completed' order by received_at desc, request_id limit 50")
def top11(spark, folder):
    return _state(spark, folder).where("status <> 'completed'").orderBy(F.desc("received_at"), "request_id").limit(50).select("request_id", "stage", "status")


@Q("top12_runs_by_start", sql("cap", body="select request_id, try_cast(regexp_replace(raw_query, '[^0-9]', '', 'g') as bigint) as started from cap"))
def top12(spark, folder):
    started = F.expr("try_cast(regexp_replace(raw_query, '[^0-9]', '') as bigint)")
    return captures(spark, folder).select("request_id", started.alias("started")).orderBy(F.desc_nulls_last("started"))


# projections --------------------------------------------------------------------------------------


@Q("prj01_light_captures", sql("ret", body="select request_id, count(*) as n_results, count(*) filter (rank <= 4) as n_selected from ret group by 1"))
def prj01(spark, folder):
    nested = retrieval_results(spark, folder).groupBy("request_id").agg(F.collect_list(F.struct("chunk_id", (F.col("rank") <= 4).alias("selected"))).alias("rr"))
    return nested.select("request_id", F.size("rr").cast("bigint").alias("n_results"), F.size(F.filter("rr", lambda x: x["selected"])).cast("bigint").alias("n_selected"))


@Q("prj02_row_by_key", "select * from orders where o_orderkey = 100")
def prj02(spark, folder):
    return table(spark, folder, "orders").where("o_orderkey = 100")


@Q("prj03_text_search", sql("cap", body="select request_id, raw_query from cap where raw_query ilike '%slower%' or normalized_query ilike '%slower%' order by received_at desc, request_id limit 50"))
def prj03(spark, folder):
    hit = F.col("raw_query").ilike("%slower%") | F.col("normalized_query").ilike("%slower%")
    return captures(spark, folder).where(hit).orderBy(F.desc("received_at"), "request_id").limit(50).select("request_id", "raw_query")


@Q("prj04_membership", "select o_orderkey, o_totalprice from orders where o_orderkey in (1, 5, 9, 33, 70, 999999)")
def prj04(spark, folder):
    return table(spark, folder, "orders").where(F.col("o_orderkey").isin(1, 5, 9, 33, 70, 999999)).select("o_orderkey", "o_totalprice")


@Q("prj05_json_path", "select event_id, try_cast(props ->> '$.k' as bigint) as k from events")
def prj05(spark, folder):
    return table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@Q("prj06_retriever_label", sql("cap", body="""select request_id, case when retriever_kind <> 'Hybrid' then retriever_kind when json_valid(retriever_config) then case try_cast(retriever_config as json) ->> '$.strategy.kind' when 'bag_of_words' then 'Hybrid - bow' when 'bm25_like' then 'Hybrid - bm25' else 'Hybrid' end else 'Hybrid' end as label from cap"""))
def prj06(spark, folder):
    kind = F.get_json_object("retriever_config", "$.strategy.kind")
    label = F.when(F.col("retriever_kind") != "Hybrid", F.col("retriever_kind")).when(kind == "bag_of_words", "Hybrid - bow").when(kind == "bm25_like", "Hybrid - bm25").when(F.col("retriever_kind").isNotNull(), "Hybrid").otherwise("Hybrid")
    return captures(spark, folder).select("request_id", label.alias("label"))


@Q("prj12_selected_context", sql("ret", body="select request_id, string_agg('[Chunk ' || rank || '] chunk_id=' || chunk_id, chr(10) order by rank) as context from ret where rank <= 4 group by 1"))
def prj12(spark, folder):
    rows = retrieval_results(spark, folder).where("rank <= 4").groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("c"))
    line = F.transform("c", lambda x: F.concat(F.lit("[Chunk "), x["rank"].cast("string"), F.lit("] chunk_id="), x["chunk_id"].cast("string")))
    return rows.select("request_id", F.array_join(line, "\n").alias("context"))


SCORES = {"complete": 1.0, "partial": 0.5, "incomplete": 0.0, "grounded": 1.0, "partially_grounded": 0.5, "ungrounded": 0.0, "relevant": 1.0, "partially_relevant": 0.5, "irrelevant": 0.0, "correct_refusal": 1.0, "unnecessary_refusal": 0.0, "non_refusal": 0.0}


@Q("prj14_label_scores", sql("gen", body="select request_id, run_id, suite_name, case " + " ".join(f"when label = '{k}' then {v}" for k, v in SCORES.items()) + " end::double as mapped from gen"))
def prj14(spark, folder):
    mapping = F.create_map(*[F.lit(x) for kv in SCORES.items() for x in kv])
    return generation_results(spark, folder).select("request_id", "run_id", "suite_name", F.try_element_at(mapping, F.col("label")).alias("mapped"))


@Q("prj15_single_kind", sql("req", body="select run_id, count(distinct retriever_kind) as kinds, count(distinct retriever_kind) = 1 as single from req group by 1"))
def prj15(spark, folder):
    n = F.count_distinct("retriever_kind")
    return requests(spark, folder).groupBy("run_id").agg(n.alias("kinds"), (n == 1).alias("single"))


@Q("prj17_unique_points", "select lower(content_hash) as content_hash, count(*) as points, count(*) > 1 as duplicated from chunks group by 1")
def prj17(spark, folder):
    return table(spark, folder, "chunks").groupBy(F.lower("content_hash").alias("content_hash")).agg(F.count("*").alias("points"), (F.count("*") > 1).alias("duplicated"))


@Q("prj19_row_counts", "select 'orders' as name, count(*) as n from orders union all select 'lineitem', count(*) from lineitem union all select 'chunks', count(*) from chunks union all select 'request_captures', count(*) from request_captures")
def prj19(spark, folder):
    out = None
    for name in ("orders", "lineitem", "chunks", "request_captures"):
        n = table(spark, folder, name).agg(F.count("*").alias("n")).withColumn("name", F.lit(name))
        out = n if out is None else out.unionByName(n)
    return out
