"""Term counts by deltas, and cutting at boundaries."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.llm import splitting as S
from corpusmill.llm import terms as T


def brute(texts):
    occ, docs = Counter(), Counter()
    for t in texts:
        w = re.findall(r"[^\W_]{2,}", (t or "").lower())
        occ.update(w)
        docs.update(set(w))
    return {t: (occ[t], docs[t]) for t in occ}


def state(counts):
    df = counts.read()
    return {} if df is None else {r.term: (r.occurrences, r.documents) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, text string")


def test_deltas_equal_a_full_count(spark):
    one = [("a", "Foo bar foo, x"), ("b", "bar baz_qux"), ("c", None), ("d", "")]
    two = [("a", "Foo bar foo, x"), ("b", "changed bar bar"), ("e", "new ÄÖ äö")]
    counts = T.TermCounts(spark, least_buckets=4).apply(T.signed_counts(frame(spark, one).withColumn("sign", F.lit(1))))
    assert state(counts) == brute(t for _, t in one)
    delta = T.delta_records(frame(spark, one), frame(spark, two), "k", "text")
    assert sorted((r.sign, r.text) for r in delta.collect()) == [(-1, ""), (-1, "bar baz_qux"), (1, "changed bar bar"), (1, "new ÄÖ äö")]
    counts.apply(T.signed_counts(delta))
    assert state(counts) == brute(t for _, t in two)
    counts.apply(T.signed_counts(T.delta_records(frame(spark, two), frame(spark, two).limit(0), "k", "text")))
    assert state(counts) == {}


def signed(spark, rows):
    return T.signed_counts(spark.createDataFrame(rows, "sign int, text string"))


def test_the_state_is_opened_again(spark, tmp_path):
    path = f"file://{tmp_path}/terms"
    assert T.TermCounts(spark, path).read() is None
    T.TermCounts(spark, path).apply(signed(spark, [(1, "alpha beta"), (1, "beta")]))
    again = T.TermCounts(spark, path)
    assert again.version == 1 and state(again) == {"alpha": (1, 1), "beta": (2, 2)}
    again.apply(signed(spark, [(-1, "beta"), (1, "gamma")]))
    third = T.TermCounts(spark, path)
    assert state(third) == {"alpha": (1, 1), "beta": (1, 1), "gamma": (1, 1)}
    third.apply(signed(spark, [(-1, "alpha beta"), (-1, "gamma")])).vacuum()
    assert state(T.TermCounts(spark, path)) == {} and len(third._list(path)) <= 2


def test_deltas_come_in_any_order(spark):
    counts = T.TermCounts(spark).apply(signed(spark, [(-1, "alpha beta")]))
    assert state(counts) == {}
    counts.apply(signed(spark, [(1, "alpha beta"), (1, "alpha")]))
    assert state(counts) == {"alpha": (1, 1)}


def test_buckets_grow_with_the_terms(spark, tmp_path):
    path = f"file://{tmp_path}/terms"
    counts = T.TermCounts(spark, path, terms_per_bucket=10, least_buckets=2)
    texts = [" ".join(f"t{i}x{k}" for k in range(12)) for i in range(9)]
    for t in texts:
        counts.apply(signed(spark, [(1, t)]))
    assert counts.buckets == 16 and state(T.TermCounts(spark, path)) == brute(texts)


def test_batches_of_a_collection(spark, small):
    """Counts of the chunks by batches of added, changed and deleted ones, against a full count."""
    from corpusmill.llm.queries import REGISTRY

    rows = spark.read.parquet(f"{small}/chunks.parquet").select("chunk_id", "text", "ingest.ingested_at").collect()
    latest = {}
    for r in sorted(rows, key=lambda r: (r.ingested_at or "", r.text or "")):
        latest[r.chunk_id] = r.text
    distinct = {t for t in latest.values() if t is not None}
    assert {r.term: (r.occurrences, r.documents) for r in REGISTRY.queries["p4_distinct_texts"](spark, small).collect()} == brute(distinct)


def test_marks(spark):
    c = spark.createDataFrame([("rare", 9, 2), ("usual", 9, 3), ("common", 99, 31), ("edge", 99, 30)], "term string, occurrences long, documents long")
    assert {r.term: r["mark"] for r in T.marked(c, 100).collect()} == {"rare": "too_rare", "usual": None, "common": "too_common", "edge": None}


def test_surplus_deliveries(spark):
    d = spark.createDataFrame([("a", "old", "1"), ("a", "new", "2"), ("b", "x", None), ("c", "same", "1"), ("c", "same", "1"), (None, "n", "1")], "k string, text string, s string")
    assert sorted(r.text for r in T.surplus_deliveries(d, "k", "text", F.col("s")).collect()) == ["old", "same"]


def test_p4_query_against_brute_force(spark, small):
    import duckdb

    from corpusmill.llm.queries import REGISTRY

    rows = duckdb.sql(f"select text from '{small}/chunks.parquet' qualify row_number() over (partition by chunk_id order by ingest.ingested_at desc) = 1").fetchall()
    counts = brute(t for (t,) in rows)
    want = {(t, "too_rare") for t, (_, n) in counts.items() if n < 3} | {(t, "too_common") for t, (_, n) in counts.items() if n > 0.3 * len(rows)}
    assert {tuple(r) for r in REGISTRY.queries["p4_found"](spark, small).collect()} == want
    assert {r.term: (r.occurrences, r.documents) for r in REGISTRY.queries["p4_counts"](spark, small).collect()} == counts


def check_pieces(text, limit, ratio):
    words = text.split()
    out = S.split_text(text, limit, ratio)
    assert all(p.end - p.start <= limit for p, *_ in out)
    assert out[0][0].start == 0 and out[-1][0].end == len(words)
    covered = 0
    for p, piece, *_ in out:
        assert piece.split() == words[p.start : p.end]
        assert p.start + p.overlap == covered  # each piece adds what follows the one before
        covered = p.end
    return out


def test_natural_and_forced_cuts():
    text = "a b c. d e f. g h i. j k l."
    out = check_pieces(text, 6, 0.0)
    assert [piece for _, piece, *_ in out] == ["a b c. d e f.", "g h i. j k l."] and not out[0][4]
    assert all(p.kind in ("natural", "end") for p, *_ in out)
    out = check_pieces("w " * 25 + "end. x y.", 10, 0.2)
    assert out[0][4] and any(p.kind == "forced" for p, *_ in out)


def test_overlap_goes_before_cheaper_cuts():
    """A page break at word 165 would leave 25 words of overlap, the sentence end at 172 leaves 30."""
    text = " ".join(["w"] * 165) + "\f" + " ".join(["w"] * 6) + " w. " + " ".join(["w"] * 168)
    out = check_pieces(text, 200, 0.15)
    assert [(p.end, p.overlap) for p, *_ in out] == [(172, 0), (340, 30)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=2, max_size=30), st.integers(8, 25), st.integers(0, 7))
def test_overlap_is_whole_where_a_chain_keeps_it(sizes, limit, overlap):
    ends = [sum(sizes[: k + 1]) for k in range(len(sizes))]
    cost = np.full(ends[-1], S.FORCED)
    cost[ends[:-1]] = np.resize([S.PAGE, S.SENTENCE, S.LINE], len(ends) - 1)
    reached = {0}
    for b in ends:
        if any(b - a + min(overlap, a) <= limit for a in reached):
            reached.add(b)
    if ends[-1] in reached:
        pieces = S.split_words(cost, limit, overlap)
        assert all(p.overlap == min(overlap, p.start + p.overlap) for p in pieces)
        assert ends[-1] <= limit or max(sizes) > limit or all(p.kind != "forced" for p in pieces)


def test_one_tight_stretch_shortens_its_own_overlap_only():
    cost = np.full(100, S.FORCED)
    cost[[10, 20, 30, 49, 60, 70, 80, 90]] = S.SENTENCE
    pieces = S.split_words(cost, 20, 5)
    assert [p.overlap for p in pieces if p.start < 49 <= p.end and p.start + p.overlap == 30] == [1]
    assert all(p.overlap == 5 for p in pieces if p.start + p.overlap not in (0, 30))


def test_pages_follow_form_feeds():
    out = S.split_text("a b c.\fd e f.\n\ng h i.\fj k l.", 6, 0.0)
    assert [(before, inside) for _, _, before, inside, _ in out] == [(0, 1), (1, 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.", "c!", "\n", "\f", "d e", "x?”", "…"]), min_size=1, max_size=120), st.integers(1, 20), st.floats(0, 0.5))
def test_pieces_cover_the_text(parts, limit, ratio):
    text = " ".join(parts)
    if text.split():
        check_pieces(text, limit, ratio)


def test_a_long_text_without_boundaries():
    out = check_pieces("w " * 20_000, 350, 0.15)
    assert out[0][4] and min(p.end - p.start for p, *_ in out) > 200


def test_chunks_above_their_limit(spark):
    ingest = "named_struct('ingested_at', s) as ingest"
    long = " ".join(["word"] * 12)
    rows = [("a", "v", long, "1", 3), ("a", "v", "short now", "2", 3), ("b", "v", long + ".", "1", None), ("b", "v", long + ".", "1", None), ("c", "?", long, "1", 1), ("d", None, long, "1", 1), ("e", "v", None, "1", 1), (None, "v", long, "1", 1), ("f", "v", "a b.\n" * 6, "1", 4)]
    d = spark.createDataFrame(rows, "chunk_id string, chunking_version string, text string, s string, page_start long").selectExpr("*", ingest, "cast(null as array<string>) as section_path", "1 as target_tokens")
    config = spark.createDataFrame([("v", 5, 0.2), (None, 1, 0.0)], "chunking_version string, target_tokens int, overlap_ratio double")
    got = S.split_oversized(d, config)
    by = {k: [r for r in got.collect() if r.chunk_id == k] for k in "abcdef"}
    assert not by["a"] and not by["c"] and not by["d"] and not by["e"]
    assert len(by["b"]) == 3 and by["b"][0].forced and by["b"][0].page_start is None
    assert not by["f"][0].forced and all(len(r.text.split()) <= 5 for r in by["f"])
    assert S.split_oversized(d.limit(0), config).count() == 0


@pytest.mark.parametrize("name", ["p5_found", "p5_pieces"])
def test_p5_queries(spark, small, name):
    from corpusmill.llm.queries import REGISTRY

    assert REGISTRY.queries[name](spark, small).count() > 0
