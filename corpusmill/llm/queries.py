"""The queries p2 to p8 on the tables of a folder, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans.entities import WHITE_SPACE
from ..plans.registry import Registry, table
from ..session import materialise
from .answers import check_pairs, pair_defects, refusal_labels, refusal_openings, response_openings
from .keyword_pages import flag_pages, scan_pages
from .mixing import mix_plan, mix_report, select_copies, source_name
from .neardup import JoinSpec, expand_pairs, near_duplicates
from .packing import pack
from .splitting import split_oversized
from .tokens import sized
from .terms import TermCounts, delta_records, marked, signed_counts, surplus_deliveries

REGISTRY = Registry()


# the sets of word triples of the chunks' latest deliveries (of all words, where a text has fewer),
# and the pairs of chunks whose sets share at least 0.6
PAIRS_SQL = r"""with latest as (select chunk_id, text from chunks where chunk_id is not null and text is not null qualify row_number() over (partition by chunk_id order by ingest.ingested_at desc nulls last) = 1),
said as (select chunk_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from latest),
sets as (select chunk_id, list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) when len(w) > 0 then [array_to_string(w, ' ')] else [chr(10) || text] end) as g from said),
grams as (select chunk_id, len(g) as n, unnest(g) as gram from sets),
common as (select a.chunk_id as chunk_id_a, b.chunk_id as chunk_id_b, a.n as na, b.n as nb, count(*) as c from grams a join grams b on a.gram = b.gram and a.chunk_id < b.chunk_id group by all)
select chunk_id_a, chunk_id_b from common where c >= 0.6 * (na + nb - c) - 1e-9"""


@REGISTRY.query("p2_found", PAIRS_SQL)
def p2_found(spark, folder):
    found = near_duplicates(table(spark, folder, "chunks"), "chunk_id", "text", "ingest.ingested_at", JoinSpec(width=3, threshold=0.6))
    return expand_pairs(found).select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


@REGISTRY.query("p2_classes")
def p2_classes(spark, folder):
    """One row a chunk: its class of equal word sets and the number of similar other classes."""
    found = near_duplicates(table(spark, folder, "chunks"), "chunk_id", "text", "ingest.ingested_at")
    links = found.pairs.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    return found.members.join(links, "class", "left").select(F.col("id").alias("chunk_id"), "class", F.coalesce("links", F.lit(0)).alias("links"))


@REGISTRY.query("p3_found")
def p3_found(spark, folder):
    checks = check_pairs(table(spark, folder, "request_captures"), "request_id", "raw_query", "final_answer", "stored_at")
    return pair_defects(checks, refusal_labels(table(spark, folder, "judge_generation_results")))


@REGISTRY.query("p3_templates")
def p3_templates(spark, folder):
    """The recurring refusal templates with their counts."""
    checks = check_pairs(table(spark, folder, "request_captures"), "request_id", "raw_query", "final_answer", "stored_at")
    return refusal_openings(response_openings(materialise(checks, "checks")), refusal_labels(table(spark, folder, "judge_generation_results")))


def _term_counts(spark, folder):
    """Counts of all chunks, and the number of chunks: every delivery is added, then the replaced
    deliveries of a key are taken off by a signed delta."""
    chunks = table(spark, folder, "chunks").where("chunk_id is not null")
    counts = TermCounts(spark).apply(signed_counts(chunks.select(F.lit(1).alias("sign"), "text")))
    surplus = surplus_deliveries(chunks, "chunk_id", "text", F.col("ingest.ingested_at"))
    counts.apply(signed_counts(surplus.select(F.lit(-1).alias("sign"), "text")))
    return counts, chunks.agg(F.count_distinct("chunk_id").alias("n"))


# the latest delivery of each chunk, its terms, and their counts
TERMS_SQL = r"""with latest as (select text from chunks where chunk_id is not null qualify row_number() over (partition by chunk_id order by ingest.ingested_at desc nulls last) = 1),
said as (select row_number() over () as id, regexp_extract_all(lower(text), '[\p{L}\p{N}]{2,}') as terms from latest),
counted as (select term, count(*) as occurrences, count(distinct id) as documents from (select id, unnest(terms) as term from said) group by term),
marked as (select term, occurrences, documents, case when documents < 3 then 'too_rare' when documents > 0.3 * (select count(*) from latest) then 'too_common' end as mark from counted) """


@REGISTRY.query("p4_found", TERMS_SQL + "select term, mark from marked where mark is not null")
def p4_found(spark, folder):
    counts, n = _term_counts(spark, folder)
    return marked(counts.read(), n).where("mark is not null").select("term", "mark")


@REGISTRY.query("p4_counts", TERMS_SQL + "select term, occurrences, documents, mark from marked")
def p4_counts(spark, folder):
    counts, n = _term_counts(spark, folder)
    return marked(counts.read(), n)


@REGISTRY.query("p4_distinct_texts", r"select term, count(*) as occurrences, count(distinct text) as documents from (select text, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]{2,}')) as term from (select distinct text from chunks where chunk_id is not null and text is not null)) group by term")
def p4_distinct_texts(spark, folder):
    """Counts over the different texts, by three batches on one state: the chunks of the first
    deliveries are added, changed texts of later deliveries replace them, and chunks whose text a
    smaller key has too are deleted."""
    chunks = table(spark, folder, "chunks").where("chunk_id is not null").select("chunk_id", "text", F.coalesce("ingest.ingested_at", F.lit("")).alias("stamp"))
    ends = chunks.groupBy("chunk_id").agg(*[f(F.struct("stamp", F.xxhash64("text"), "text"))["text"].alias(n) for f, n in ((F.min, "first"), (F.max, "last"))])
    ends = materialise(ends, "ends")
    first, last = ends.select("chunk_id", F.col("first").alias("text")), ends.select("chunk_id", F.col("last").alias("text"))
    kept = last.where("text is not null").groupBy("text").agg(F.min("chunk_id").alias("chunk_id")).select("chunk_id", "text")
    counts = TermCounts(spark)
    for old, new in ((first.limit(0), first), (first, last), (last, kept)):
        counts.apply(signed_counts(delta_records(old, new, "chunk_id", "text")))
    return counts.read()


SNAPSHOT_SQL = TERMS_SQL + """, snap as (select *, row_number() over (partition by collection_name order by created_at desc, document_count desc) as rn from bm25_term_stats),
held as (select collection_name, vocabulary_name, document_count, unnest(map_entries(document_frequency_by_token_id)) as e from snap where rn = 1 and document_count > 0),
named as (select h.collection_name, v.token as term, h.document_count as documents_then, h.e.value as held from held h join sparse_vocabulary v on v.vocabulary_name = h.vocabulary_name and v.token_id = h.e.key)
select collection_name, term, held, documents_then, coalesce(m.documents, 0) as documents, (select count(*) from latest) as documents_now from named left join marked m using (term)"""


@REGISTRY.query("p4_against_snapshots", SNAPSHOT_SQL)
def p4_against_snapshots(spark, folder):
    """Document counts that the latest usable snapshot of each collection held, beside today's.

    Snapshots without a positive ``document_count`` are unusable; of a repeated one one row counts."""
    counts, n = _term_counts(spark, folder)
    snapshots = table(spark, folder, "bm25_term_stats")
    turn = Window.partitionBy("collection_name").orderBy(F.desc("created_at"), F.desc("document_count"))
    latest = snapshots.withColumn("turn", F.row_number().over(turn)).where("turn = 1 and document_count > 0")
    held = latest.select("collection_name", "vocabulary_name", F.col("document_count").alias("documents_then"), F.explode("document_frequency_by_token_id").alias("token_id", "held"))
    named = held.join(table(spark, folder, "sparse_vocabulary"), ["vocabulary_name", "token_id"]).select("collection_name", F.col("token").alias("term"), "held", "documents_then")
    return named.join(counts.read().select("term", "documents"), "term", "left").crossJoin(F.broadcast(n)).select("collection_name", "term", "held", "documents_then", F.coalesce("documents", F.lit(0)).alias("documents"), F.col("n").alias("documents_now"))


# stretches between natural boundaries and their words
CUTS_SQL = rf"""with latest as (select c.chunk_id, c.text, target_tokens from (select * from chunks where chunk_id is not null and text is not null qualify row_number() over (partition by chunk_id order by ingest.ingested_at desc nulls last) = 1) c join chunker_config using (chunking_version)),
cut as (select chunk_id, target_tokens, text, regexp_split_to_array(regexp_replace(text, '([.!?…]["''”’»›)\]}}“]*){WHITE_SPACE}', '\1' || chr(10), 'g'), '[\n\r\x0B\x0C\x{{85}}\x{{2028}}\x{{2029}}]+') as stretches from latest)
select chunk_id, case when list_max(list_transform(stretches, lambda x: len(regexp_split_to_array(regexp_replace(x, '^{WHITE_SPACE}|{WHITE_SPACE}$', '', 'g'), '{WHITE_SPACE}')))) > target_tokens then 'forced' else 'natural' end as cut
from cut where len(regexp_split_to_array(regexp_replace(text, '^{WHITE_SPACE}|{WHITE_SPACE}$', '', 'g'), '{WHITE_SPACE}')) > target_tokens"""


@REGISTRY.query("p5_found", CUTS_SQL)
def p5_found(spark, folder):
    """How the pieces of each oversized chunk were cut: forced if any cut had to go between words."""
    pieces = split_oversized(table(spark, folder, "chunks"), table(spark, folder, "chunker_config"))
    return pieces.groupBy("chunk_id").agg(F.when(F.max(F.col("cut") == "forced"), F.lit("forced")).otherwise(F.lit("natural")).alias("cut"))


@REGISTRY.query("p5_pieces")
def p5_pieces(spark, folder):
    return split_oversized(table(spark, folder, "chunks"), table(spark, folder, "chunker_config"))


@REGISTRY.query("p8_found")
def p8_found(spark, folder):
    return flag_pages(scan_pages(table(spark, folder, "documents"))).where("spam").select("doc_id")


@REGISTRY.query("p8_curves")
def p8_curves(spark, folder):
    """Every page with its rank-frequency fit, flag and share of words outside sentences."""
    return flag_pages(scan_pages(table(spark, folder, "documents")))


@REGISTRY.query("p6_found")
def p6_found(spark, folder):
    """Documents whose pieces lie in more than one container."""
    packed = p6_containers(spark, folder).where("container is not null")
    return packed.groupBy("doc_id").agg(F.min("container").alias("low"), F.max("container").alias("high")).where("low < high").select("doc_id")


@REGISTRY.query("p6_containers")
def p6_containers(spark, folder):
    return pack(sized(table(spark, folder, "documents"), "doc_id", "text", "fetched_at"), "doc_id", 2048)


@REGISTRY.query("p6_fill")
def p6_fill(spark, folder):
    """Every container with its pieces, tokens and unused room."""
    packed = p6_containers(spark, folder).where("container is not null")
    return packed.groupBy("container").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens")).withColumn("unused", 2048 - F.col("tokens"))


def _mixed(spark, folder):
    docs = materialise(sized(table(spark, folder, "documents"), "doc_id", "text", "fetched_at", {"source": source_name(F.col("source"))}), "sized")
    plan = mix_plan(docs, table(spark, folder, "mix_targets"))
    return plan, select_copies(docs, plan)


# in characters instead of tokens: what can be reached is the same
REACH_SQL = r"""with docs as (select lower(trim(source, chr(9) || chr(10) || chr(13) || ' ')) as source, length(text) as n from documents where doc_id is not null and text is not null qualify row_number() over (partition by doc_id order by fetched_at desc nulls last) = 1),
held as (select source, sum(n) as n from docs group by source),
mix as (select mix_name, lower(trim(source, chr(9) || chr(10) || chr(13) || ' ')) as source, sum(target_share) as share, max(max_repeats) as repeats from mix_targets group by 1, 2)
select mix_name, source from mix left join held using (source) where coalesce(n, 0) * repeats < share * (select sum(n) from docs)"""


@REGISTRY.query("p7_found", REACH_SQL)
def p7_found(spark, folder):
    """Rows of the targets that the mix falls short of with every copy used that it may use."""
    report = mix_report(*_mixed(spark, folder))
    return report.where("actual_tokens = source_tokens * max_repeats and actual_tokens < target_tokens").select("mix_name", "source")


@REGISTRY.query("p7_shares")
def p7_shares(spark, folder):
    return mix_report(*_mixed(spark, folder))


@REGISTRY.query("p7_selection")
def p7_selection(spark, folder):
    return _mixed(spark, folder)[1]
