"""The grouped prefix join against brute force, and its edge cases."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from corpusmill.llm import neardup as N
from corpusmill.llm import wordscan as W


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def brute_set(text, width):
    w = words(text)
    if len(w) >= width:
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    return {("short", *w)} if w else {("raw", text)}


def brute(rows, width, t):
    sets = {k: brute_set(x, width) for k, x in rows}
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


def test_scanner_agrees_with_the_pattern():
    texts = ["Ünï-cödé_x 12 a.b", "", "   ", "one", "ÇA va? 北京 2024", "a\x00b", "x" * 5000 + " y", "ß İ ŉ"]
    hashes, bounds = W.scan_words(texts)
    seen = {}
    for i, t in enumerate(texts):
        w = words(t)
        assert bounds[i + 1] - bounds[i] == len(w)
        for word, h in zip(w, hashes[bounds[i] : bounds[i + 1]].tolist()):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    assert W.scan_words([])[0].size == 0 and W.scan_words(["", "."])[1].tolist() == [0, 0, 0]


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, base = [], [[rng.choice(vocabulary) for _ in range(rng.randrange(8, 120))] for _ in range(n // 4)]
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 8)):
            k = rng.randrange(len(w))
            what = rng.randrange(3)
            if what == 0:
                w[k] = rng.choice(vocabulary)
            elif what == 1:
                w.insert(k, rng.choice(vocabulary))
            elif len(w) > 4:
                del w[k]
        rows.append((f"d{i:04d}", " ".join(w)))
    return rows


@pytest.mark.parametrize("width, t, block", [(3, 0.6, 2048), (5, 0.8, 2048), (2, 0.5, 3)])
def test_join_against_brute_force(spark, width, t, block):
    rows = corpus(width, 240) + [("e1", "a b"), ("e2", "A, b!"), ("e3", "..."), ("e4", "..."), ("e5", ""), ("e6", ""), ("e7", "a"), ("e8", "b a")]
    d = spark.createDataFrame(rows, "id string, text string").repartition(5)
    spec = N.JoinSpec(width=width, threshold=t, sketch_bits=14, block=block, postings=1500)
    found = N.expand_pairs(N.near_duplicates(d, "id", "text", spec=spec)).collect()
    assert len(found) == len(set(found))
    assert {(r.id_a, r.id_b) for r in found} == brute(rows, width, t)


@pytest.mark.parametrize("buckets", [8, 100, 4000])
def test_records_hold_every_posting_once(buckets):
    """A bucket gets a document once: at most a record a prefix shingle, however many buckets."""

    class Shared:
        value = bytes([9]) * (1 << 14)

    texts = [x for _, x in corpus(4, 200)]
    spec = N.JoinSpec(width=3, threshold=0.6, sketch_bits=14)
    out = list(N._postings(spec, Shared, buckets, 9.0)(iter([pa.record_batch([pa.array(texts)], names=["text"])])))
    posts = [N._unpack(p) for b in out for p in b["post"].to_pylist()]
    sets = {frozenset(brute_set(x, 3)) for x in texts}
    prefix = sum(int(N.prefix_length(len(s), 0.6)) for s in sets)
    assert sum(len(p[4]) for p in posts) == sum(int(p[3].sum()) for p in posts) == prefix
    assert len(posts) <= buckets and all(len(p[6]) == N.map_words(p[2].astype(int)).sum() for p in posts)
    assert sum(len(p[0]) for p in posts) <= min(prefix, buckets * len(sets))


@pytest.mark.parametrize("block", [2048, 3])
def test_waves_of_buckets_against_brute_force(spark, monkeypatch, block):
    """Many buckets are filled in waves: each is asked to release its shuffle files, and the pairs are those of the definition."""
    from corpusmill import session

    lean_ = []

    def materialise(df, name, lean=False):
        out = session.materialise(df, name, lean)
        if name == "met":
            lean_.append(lean)
        return out

    monkeypatch.setattr(N, "materialise", materialise)
    rows = corpus(6, 240)
    d = spark.createDataFrame(rows, "id string, text string").repartition(5)
    spec = N.JoinSpec(width=3, threshold=0.6, sketch_bits=14, block=block, postings=60, wave=0.4)
    found = N.expand_pairs(N.near_duplicates(d, "id", "text", spec=spec)).collect()
    assert len(found) == len(set(found)) and {(r.id_a, r.id_b) for r in found} == brute(rows, 3, 0.6)
    assert len(lean_) > 3 and all(lean_)


def test_waves_hold_every_posting_once():
    class Shared:
        value = bytes([9]) * (1 << 14)

    texts = [x for _, x in corpus(4, 200)]
    spec = N.JoinSpec(width=3, threshold=0.6, sketch_bits=14)
    stored = list(N._prefixes(spec, Shared, 9.0)(iter([pa.record_batch([pa.array(texts)], names=["text"])])))
    all_, some = ([[r for b in N._wave(120, waves, w)(iter(stored)) for r in zip(b["bucket"].to_pylist(), b["post"].to_pylist())] for w in range(waves)] for waves in (1, 5))
    assert sum(len(p) for _, p in all_[0]) > 4 * max(sum(len(p) for _, p in w) for w in some)
    assert {(b * 5 + w, p) for w, records in enumerate(some) for b, p in records} == set(all_[0])


def test_bitmaps_of_several_sizes():
    rng = np.random.default_rng(3)
    sizes = np.array([1, 4, 512, 2, 4, 64])
    maps = [rng.integers(0, 1 << 63, s).astype(np.uint64) for s in sizes]
    b = N._Bitmaps(np.concatenate(maps), np.cumsum(sizes) - sizes, sizes)
    i, j = (x.ravel() for x in np.indices((6, 6)))

    def fold(m, s):
        return np.bitwise_xor.reduce(m.reshape(-1, s), axis=0)

    want = [int(np.bitwise_count(fold(maps[x], min(sizes[x], sizes[y])) ^ fold(maps[y], min(sizes[x], sizes[y]))).sum()) for x, y in zip(i, j)]
    assert b.distance(i, j).tolist() == want
    assert len(b.level(512)[0]) == 1  # no room for the bitmaps of smaller documents


def test_large_classes_are_expanded_in_blocks(spark):
    rows = [(f"a{i:02d}", 1) for i in range(23)] + [(f"b{i}", 2) for i in range(3)] + [("c", 3)]
    found = N.NearDuplicates(spark.createDataFrame(rows, "id string, class long"), spark.createDataFrame([(1, 2, 0.9)], "class_a long, class_b long, similarity double"))
    want = {(x, y) for x, a in rows for y, b in rows if x < y and 3 not in (a, b)}
    got = [tuple(r) for r in N.expand_pairs(found, block=4).collect()]
    assert len(got) == len(want) and set(got) == want


def test_one_text_in_a_third_of_all_rows(spark):
    rows = corpus(9, 60) + [(f"h{i}", "the same hot text in very many of the rows of this table here") for i in range(30)]
    d = spark.createDataFrame(rows, "id string, text string")
    found = N.near_duplicates(d, "id", "text", spec=N.JoinSpec(width=3, threshold=0.6, sketch_bits=14))
    assert {(r.id_a, r.id_b) for r in N.expand_pairs(found).collect()} == brute(rows, 3, 0.6)
    assert found.members.where("id like 'h%'").select("class").distinct().count() == 1


def test_deliveries_nulls_and_foreign_columns(spark):
    rows = [("a", "x y z u v", "1", 7), ("a", "q r s t w", "2", 7), ("b", "q r s t w", None, 7), ("c", None, "1", 7), (None, "q r s t w", "1", 7)]
    d = spark.createDataFrame(rows, "id string, text string, stamp string, class int")
    spec = N.JoinSpec(width=3, threshold=0.6, sketch_bits=14)
    assert [tuple(r) for r in N.expand_pairs(N.near_duplicates(d, "id", "text", "stamp", spec)).collect()] == [("a", "b")]
    empty = N.near_duplicates(d.limit(0), "id", "text", "stamp", spec)
    assert empty.members.count() == 0 and N.expand_pairs(empty).count() == 0


def test_counts_are_never_underestimated():
    c = np.array([0, 1, 2, 63, 64, 65, 100, 1000, 10**6])
    assert (N.decode_count(N._encode_counts(c)) >= c - 1e-9).all() and N._encode_counts(c)[1] == 1


def test_p2_queries(spark, small):
    import duckdb

    from corpusmill.llm.queries import REGISTRY

    rows = duckdb.sql(f"select chunk_id, text from '{small}/chunks.parquet' where text is not null qualify row_number() over (partition by chunk_id order by ingest.ingested_at desc) = 1").fetchall()
    got = REGISTRY.queries["p2_found"](spark, small)
    assert got.columns == ["chunk_id_a", "chunk_id_b"] and {tuple(r) for r in got.collect()} == brute(rows, 3, 0.6)
    classes = REGISTRY.queries["p2_classes"](spark, small)
    assert classes.count() == len(rows)
