"""Retrieval and its metrics: dense, sparse and fused top-k, ranking metrics, reranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import rerank as R
from ..operators import retrieval as V
from ..operators import sparse as S
from .entities import WHITE_SPACE, chunks, rerank_candidates, retrieval_results, sql
from .registry import Registry, table

REGISTRY = Registry()
Q = REGISTRY.query

TOP12 = """dense as (select query_id, item_id, score, rank from (select q.vec_id as query_id, e.vec_id as item_id, round(list_dot_product(q.embedding::double[], e.embedding::double[]), 6) as score,
  row_number() over (partition by q.vec_id order by round(list_dot_product(q.embedding::double[], e.embedding::double[]), 6) desc, e.vec_id) as rank
  from embeddings q join embeddings e on true where q.vec_id % 100 = 0) where rank <= 12)"""
QRELS = """qrels as (select q.vec_id as query_id, e.vec_id as item_id, case when e.vec_id % 2 = 0 then 1.0 else 0.5 end::double as grade, true as is_soft, e.vec_id % 2 = 0 as is_strict
  from embeddings q join embeddings e on q.label = e.label where q.vec_id % 100 = 0)"""
METRICS = """, top as (select query_id, item_id, rank from dense),
 hit as (select t.query_id, t.rank, r.grade, r.is_soft, r.is_strict from top t join qrels r using (query_id, item_id)),
 sizes as (select query_id, count(*) filter (is_soft) as n_soft, count(*) filter (is_strict) as n_strict from qrels group by 1),
 seen as (select query_id, count(*) filter (is_soft) as h_soft, count(*) filter (is_strict) as h_strict, min(rank) filter (is_soft) as f_soft, min(rank) filter (is_strict) as f_strict, sum(grade / log2(rank + 1.0)) as dcg from hit group by 1),
 ideal as (select query_id, sum(grade / log2(r + 1.0)) as ideal from (select *, row_number() over (partition by query_id order by grade desc, item_id) as r from qrels) where r <= 12 group by 1),
 m as (select query_id, case when n_soft > 0 then coalesce(h_soft, 0) / n_soft else 0 end as recall_soft, case when n_strict > 0 then coalesce(h_strict, 0) / n_strict else 0 end as recall_strict,
  coalesce(1.0 / f_soft, 0) as rr_soft, coalesce(1.0 / f_strict, 0) as rr_strict, f_soft as first_rank_soft, f_strict as first_rank_strict, coalesce(h_soft, 0) as num_relevant_soft, coalesce(h_strict, 0) as num_relevant_strict,
  case when ideal > 0 then coalesce(dcg, 0) / ideal else 0 end as ndcg from sizes left join seen using (query_id) left join ideal using (query_id))"""


def _queries(spark, folder):
    e = table(spark, folder, "embeddings")
    return e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), "label"), e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")


def dense12(spark, folder):
    corpus, queries = _queries(spark, folder)
    return V.dense_top_k(corpus, queries, 12)


def qrels(spark, folder):
    corpus, queries = _queries(spark, folder)
    strict = F.col("item_id") % 2 == 0
    return queries.select("query_id", "label").join(corpus.select("item_id", "label"), "label").select("query_id", "item_id", F.when(strict, 1.0).otherwise(0.5).alias("grade"), F.lit(True).alias("is_soft"), strict.alias("is_strict"))


@Q("top01_dense_topk", f"with {TOP12} select query_id, item_id, score, cast(rank as int) as rank from dense")
def top01(spark, folder):
    return dense12(spark, folder)


@Q("jon17_dense_threshold", f"with {TOP12} select query_id, item_id, score, cast(rank as int) as rank from dense where score >= 0.3")
def jon17(spark, folder):
    corpus, queries = _queries(spark, folder)
    return V.dense_top_k(corpus, queries, 12, threshold=0.3)


def _metrics(spark, folder):
    return M.ranking_metrics(dense12(spark, folder), qrels(spark, folder), 12)


@Q("agg22_ranking_metrics", f"with {TOP12}, {QRELS} {METRICS} select query_id, round(recall_soft, 6) as recall_soft, round(recall_strict, 6) as recall_strict, round(rr_soft, 6) as rr_soft, round(rr_strict, 6) as rr_strict, first_rank_soft::bigint as first_rank_soft, first_rank_strict::bigint as first_rank_strict, num_relevant_soft, num_relevant_strict, round(ndcg, 6) as ndcg from m")
def agg22(spark, folder):
    m = _metrics(spark, folder)
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall_soft", "recall_strict", "rr_soft", "rr_strict")], *[F.col(c).cast("bigint").alias(c) for c in ("first_rank_soft", "first_rank_strict", "num_relevant_soft", "num_relevant_strict")], F.round("ndcg", 6).alias("ndcg"))


@Q("agg01_run_means", f"with {TOP12}, {QRELS} {METRICS} select 12 as k, count(*) as requests, round(avg(recall_soft), 6) as recall_soft, round(avg(recall_strict), 6) as recall_strict, round(avg(rr_soft), 6) as rr_soft, round(avg(rr_strict), 6) as rr_strict, round(avg(ndcg), 6) as ndcg, round(avg(num_relevant_soft), 6) as num_relevant_soft, round(avg(num_relevant_strict), 6) as num_relevant_strict, round(avg(first_rank_soft), 6) as first_rank_soft from m")
def agg01(spark, folder):
    m = _metrics(spark, folder)
    return m.agg(F.lit(12).alias("k"), F.count("*").alias("requests"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall_soft", "recall_strict", "rr_soft", "rr_strict", "ndcg", "num_relevant_soft", "num_relevant_strict", "first_rank_soft")])


@Q("win01_first_unique", sql("ret", body="""select request_id, chunk_id, cast(rank as int) as rank from (select request_id, chunk_id, row_number() over (partition by request_id order by r, chunk_id) as rank
  from (select request_id, chunk_id, min(rank) as r from ret group by 1, 2)) where rank <= 4"""))
def win01(spark, folder):
    return M.first_unique(retrieval_results(spark, folder), "request_id", "chunk_id", "rank", 4)


@Q("win02_reciprocal_rank", sql("ret", body="""select request_id, min(rank) filter (score = 1.0)::bigint as first_rank, round(coalesce(1.0 / min(rank) filter (score = 1.0), 0), 6) as rr from ret group by 1"""))
def win02(spark, folder):
    first = F.min(F.when(F.col("score") == 1.0, F.col("rank")))
    return retrieval_results(spark, folder).groupBy("request_id").agg(first.cast("bigint").alias("first_rank"), F.round(F.coalesce(1.0 / first, F.lit(0.0)), 6).alias("rr"))


@Q("win03_recall_at_k", sql("ret", body="""select request_id, round(count(distinct chunk_id) filter (rank <= 4 and score > 0) / greatest(count(distinct chunk_id) filter (score > 0), 1), 6) as recall from ret group by 1"""))
def win03(spark, folder):
    r = retrieval_results(spark, folder)
    hit, all_ = F.count_distinct(F.when((F.col("rank") <= 4) & (F.col("score") > 0), F.col("chunk_id"))), F.count_distinct(F.when(F.col("score") > 0, F.col("chunk_id")))
    return r.groupBy("request_id").agg(F.round(hit / F.greatest(all_, F.lit(1)), 6).alias("recall"))


@Q("win04_dcg", sql("ret", body="select request_id, round(sum(score / log2(rank + 1.0)), 6) as dcg from ret group by 1"))
def win04(spark, folder):
    return retrieval_results(spark, folder).groupBy("request_id").agg(F.round(F.sum(M.gain(F.col("score"), F.col("rank"))), 6).alias("dcg"))


@Q("win05_ndcg", sql("ret", body="""with i as (select request_id, sum(score / log2(r + 1.0)) as ideal from (select *, row_number() over (partition by request_id order by score desc, rank) as r from ret) where r <= 4 group by 1),
 d as (select request_id, sum(score / log2(rank + 1.0)) filter (rank <= 4) as dcg from ret group by 1)
 select request_id, round(case when ideal > 0 then coalesce(dcg, 0) / ideal else 0 end, 6) as ndcg from d join i using (request_id)"""))
def win05(spark, folder):
    r = retrieval_results(spark, folder)
    ideal = M.ideal_gain(r, "request_id", "score", "rank", 4)
    dcg = r.groupBy("request_id").agg(F.sum(F.when(F.col("rank") <= 4, M.gain(F.col("score"), F.col("rank")))).alias("dcg"))
    return dcg.join(ideal, "request_id").select("request_id", F.round(M.ratio(F.coalesce("dcg", F.lit(0.0)), F.col("ideal")), 6).alias("ndcg"))


@Q("jon22_graded_left", sql("ret", body="""with g as (select distinct p_partkey as chunk_id, p_size / 50.0 as grade from part where p_size > 25)
 select request_id, rank, ret.chunk_id, coalesce(grade, 0)::double as grade from ret left join g using (chunk_id)"""))
def jon22(spark, folder):
    g = table(spark, folder, "part").where("p_size > 25").select(F.col("p_partkey").alias("chunk_id"), (F.col("p_size") / 50.0).cast("double").alias("grade")).distinct()
    return retrieval_results(spark, folder).join(g, "chunk_id", "left").select("request_id", "rank", "chunk_id", F.coalesce("grade", F.lit(0.0)).alias("grade"))


# sparse side --------------------------------------------------------------------------------------

TOKENS = r"""tok as (select chunk_id, t as token, pos from (select chunk_id, regexp_replace(regexp_replace(lower(w), '^[^\p{L}\p{N}]+', ''), '[^\p{L}\p{N}]+$', '') as t, pos
   from (select chunk_id, unnest(regexp_split_to_array(text, '[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')) as w, generate_subscripts(regexp_split_to_array(text, '[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), 1) as pos from chk where text is not null)) where length(t) >= 2)"""
CHUNK_NO = "num as (select chunk_id, row_number() over (order by doc_id, chunk_index, chunk_id) - 1 as chunk_no from chk)"
VOCAB = "vocab as (select token, row_number() over (order by chunk_no, pos) - 1 as token_id from (select token, min_by(chunk_no, (chunk_no, pos)) as chunk_no, min_by(pos, (chunk_no, pos)) as pos from tok join num using (chunk_id) group by 1))"
STATS = ", tf as (select chunk_id, token, count(*) as tf from tok group by 1, 2), dl as (select chunk_id, sum(tf) as dl from tf group by 1), n as (select count(*) as n from dl), av as (select avg(dl) as avgdl from dl), df as (select token, count(*) as df from tf group by 1)"


def tokens(spark, folder):
    return S.tokens(chunks(spark, folder), "chunk_id", "text")


@Q("str14_canonical_tokens", sql("chk", body=f"with {TOKENS} select chunk_id, count(*) as tokens, count(distinct token) as different, min(token) as first, max(token) as last from tok group by 1"))
def str14(spark, folder):
    return tokens(spark, folder).groupBy("chunk_id").agg(F.count("*").alias("tokens"), F.count_distinct("token").alias("different"), F.min("token").alias("first"), F.max("token").alias("last"))


@Q("agg23_vocabulary", sql("chk", body=f"with {TOKENS}, {CHUNK_NO}, {VOCAB} select token, token_id from vocab"))
def agg23(spark, folder):
    return S.vocabulary(tokens(spark, folder), S.numbered(chunks(spark, folder), "chunk_id", ["doc_id", "chunk_index", "chunk_id"]), "chunk_id")


@Q("agg24_term_stats", sql("chk", body=f"with {TOKENS} {STATS} select token, df, (select n from n) as document_count, round((select avgdl from av), 6) as average_document_length from df"))
def agg24(spark, folder):
    per_token, corpus = S.term_stats(S.term_frequencies(tokens(spark, folder), "chunk_id"), "chunk_id")
    return per_token.crossJoin(F.broadcast(corpus)).select("token", "df", F.col("documents").alias("document_count"), F.round("avgdl", 6).alias("average_document_length"))


@Q("agg25_bow_vectors", sql("chk", body=f"with {TOKENS}, tf as (select chunk_id, token, count(*) as tf from tok group by 1, 2) select chunk_id, token, tf as weight from tf"))
def agg25(spark, folder):
    return S.term_frequencies(tokens(spark, folder), "chunk_id").select("chunk_id", "token", F.col("tf").alias("weight"))


@Q("jon15_vocabulary_lookup", sql("chk", body=f"with {TOKENS}, v as (select distinct token from sparse_vocabulary) select chunk_id, count(v.token) as known, count(*) - count(v.token) as unknown from tok left join v using (token) group by 1"))
def jon15(spark, folder):
    vocab = table(spark, folder, "sparse_vocabulary").select("token").distinct().withColumn("hit", F.lit(1))
    joined = tokens(spark, folder).join(vocab, "token", "left")
    return joined.groupBy("chunk_id").agg(F.count("hit").alias("known"), (F.count("*") - F.count("hit")).alias("unknown"))


IDF = ", idf as (select token, ln(n - df + 0.5) - ln(df + 0.5) as raw from df, n), mean as (select avg(raw) as m from idf), okapi as (select token, case when raw < 0 then 0.25 * m else raw end as idf from idf, mean)"


@Q("mth03_bm25_document_weights", sql("chk", body=f"with {TOKENS} {STATS} {IDF} select chunk_id, token, round(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)), 5) as weight from tf join dl using (chunk_id) join okapi using (token), av"))
def mth03(spark, folder):
    return S.bm25_document_weights(tokens(spark, folder), "chunk_id").select("chunk_id", "token", F.round("weight", 5).alias("weight"))


QTOK = """q as (select request_id as query_id, unnest(list_distinct(regexp_extract_all(lower(normalized_query), '[\\p{L}\\p{N}]{2,}'))) as token from cap where normalized_query is not null)"""


def _query_tokens(spark, folder):
    from .entities import captures

    words = F.array_distinct(F.regexp_extract_all(F.lower("normalized_query"), F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0)))
    return captures(spark, folder).where("normalized_query is not null").select(F.col("request_id").alias("query_id"), F.explode(words).alias("token"))


@Q("mth05_bow_query_weights", sql("cap", body=f"with {QTOK} select query_id, token, 1.0::double as weight from q"))
def mth05(spark, folder):
    return _query_tokens(spark, folder).withColumn("weight", F.lit(1.0))


QW = ", qw as (select query_id, token, ln(1 + (n - df + 0.5) / (df + 0.5)) as w from q join df using (token), n)"


@Q("mth04_bm25_query_weights", sql("chk", "cap", body=f"with {TOKENS} {STATS}, {QTOK} {QW} select query_id, token, round(w, 6) as weight from qw"))
def mth04(spark, folder):
    tf = S.term_frequencies(tokens(spark, folder), "chunk_id")
    return S.bm25_query_weights(_query_tokens(spark, folder), tf, "chunk_id").select("query_id", "token", F.round("weight", 6).alias("weight"))


@Q("jon16_sparse_dot", sql("chk", "cap", body=f"""with {TOKENS} {STATS}, {QTOK}, s as (select query_id, chunk_id as item_id, round(sum(tf), 6)::double as score from q join tf using (token) group by 1, 2)
 select query_id, item_id, score, cast(rank as int) as rank from (select *, row_number() over (partition by query_id order by score desc, item_id) as rank from s) where rank <= 12"""))
def jon16(spark, folder):
    docs = S.term_frequencies(tokens(spark, folder).repartition("chunk_id"), "chunk_id").select(F.col("chunk_id").alias("item_id"), F.col("token").alias("token_id"), F.col("tf").cast("double").alias("weight"))
    queries = _query_tokens(spark, folder).select("query_id", F.col("token").alias("token_id"), F.lit(1.0).alias("weight"))
    return V.sparse_top_k(queries, docs, 12)


# fusion: the dense branch and a second branch over the same vectors ranked by their first half ------

HALF = TOP12.replace("dense as", "half as").replace("q.embedding::double[]", "q.embedding[:32]::double[]").replace("e.embedding::double[]", "e.embedding[:32]::double[]")
FUSED = f"with {TOP12}, {HALF}, u as (select query_id, item_id, 1.0 / (2 + rank - 1) as s from dense union all select query_id, item_id, 1.0 / (2 + rank - 1) from half), f as (select query_id, item_id, round(sum(s), 6)::double as score from u group by 1, 2)"


def _branches(spark, folder):
    corpus, queries = _queries(spark, folder)
    half = lambda d: d.withColumn("vector", F.slice("vector", 1, 32))
    return [V.dense_top_k(corpus, queries, 12), V.dense_top_k(half(corpus), half(queries), 12)]


@Q("jon18_rank_fusion", FUSED + " select query_id, item_id, score, cast(rank as int) as rank from (select *, row_number() over (partition by query_id order by score desc, item_id) as rank from f) where rank <= 24")
def jon18(spark, folder):
    return V.rank_fusion(_branches(spark, folder), 24)


@Q("top02_hybrid_threshold", FUSED + " select query_id, item_id, score, cast(rank as int) as rank from (select *, row_number() over (partition by query_id order by score desc, item_id) as rank from f where score >= 0.2) where rank <= 12")
def top02(spark, folder):
    return V.rank_fusion(_branches(spark, folder), 12, threshold=0.2)


# reranking ----------------------------------------------------------------------------------------

RERANK = r"""base as (select cap.request_id as query_id, lower(trim(regexp_replace(raw_query, 'WS', ' ', 'g'))) as query, c.chunk_id as item_id, lower(c.text) as body, lower(coalesce(c.document_title, '') || ' ' || coalesce(c.section_title, '')) as head,
   (hash_no % 97) / 97.0 as score, rank from (select request_id, raw_query, row_number() over (order by request_id) - 1 as n from cap where raw_query is not null) cap
   join (select chunk_id, text, document_title, section_title, n as hash_no, n as rank, n // 8 as grp from (select *, row_number() over (order by chunk_id) - 1 as n from chk)) c on c.grp = cap.n % (select ceil(count(*) / 8)::bigint from chk))""".replace("WS", WHITE_SPACE)


@Q("top03_heuristic_rerank", sql("cap", "chk", body=f"""with {RERANK},
 terms as (select *, list_filter(string_split(query, ' '), lambda t: strlen(t) > 1) as q, string_split_regex(body, '{WHITE_SPACE}') as b, string_split_regex(head, '{WHITE_SPACE}') as h from base),
 lim as (select query_id, min(score) as lo, max(score) as hi from terms group by 1),
 parts as (select query_id, item_id, rank, case when hi > lo then (score - lo) / (hi - lo) else 1.0 end as norm,
   case when len(list_distinct(q)) > 0 then len(list_filter(list_distinct(q), lambda t: list_contains(b, t))) / len(list_distinct(q)) else 0 end as coverage,
   case when len(q) = 0 then 0.0 when contains(body, query) then 1.0 when len(q) > 1 and len(list_filter(list_transform(range(1, len(q)), lambda i: q[i] || ' ' || q[i + 1]), lambda p: contains(body, p))) > 0 then 0.5 else 0.0 end as phrase,
   case when len(list_distinct(q)) > 0 then len(list_filter(list_distinct(q), lambda t: list_contains(h, t))) / len(list_distinct(q)) else 0 end as title
   from terms join lim using (query_id)),
 s as (select *, round(0.5 * norm + 2.0 * coverage + 1.0 * phrase + 1.0 * title, 6) as score from parts)
 select query_id, item_id, score, cast(row_number() over (partition by query_id order by score desc, rank) as int) as rank from s"""))
def top03(spark, folder):
    weights = {"retrieval_score": 0.5, "query_term_coverage": 2.0, "phrase_match_bonus": 1.0, "title_section_match_bonus": 1.0}
    return R.heuristic_rerank(rerank_candidates(spark, folder), weights).select("query_id", "item_id", "score", "rank")


@Q("top06_final_k", sql("ret", body="select request_id, chunk_id, rank, rank <= 4 as selected from ret where rank <= 12"))
def top06(spark, folder):
    return R.select_final(retrieval_results(spark, folder).where("rank <= 12"), 4).select("request_id", "chunk_id", "rank", "selected")


@Q("top04_merge_batches_global", sql("ret", body="select request_id, rank as original, cast(row_number() over (partition by request_id order by score desc, rank) as int) as rank from ret"))
def top04(spark, folder):
    return R.merge_batches(retrieval_results(spark, folder).withColumnRenamed("rank", "original"), "request_id", batch_size=2, global_sort=True).select("request_id", "original", "rank")


@Q("top05_merge_batches_in_turn", sql("ret", body="select request_id, rank as original, cast(row_number() over (partition by request_id order by (rank - 1) // 2, score desc, rank) as int) as rank from ret"))
def top05(spark, folder):
    return R.merge_batches(retrieval_results(spark, folder).withColumnRenamed("rank", "original"), "request_id", batch_size=2, global_sort=False).select("request_id", "original", "rank")


@Q("mth01_min_max", sql("ret", body="select request_id, rank, round(case when hi > lo then (retrieval_score - lo) / (hi - lo) else 1.0 end, 6) as norm from (select *, min(retrieval_score) over (partition by request_id) as lo, max(retrieval_score) over (partition by request_id) as hi from ret)"))
def mth01(spark, folder):
    return retrieval_results(spark, folder).withColumn("norm", F.round(R.min_max(F.col("retrieval_score"), "request_id"), 6)).select("request_id", "rank", "norm")
