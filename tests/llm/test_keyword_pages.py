"""Pages without sentences."""

import math
import random
from collections import Counter

import pytest

from corpusmill.llm import keyword_pages as K

PROSE = "The leader sends every write to the followers before it answers. If a follower is down, the write waits until it comes back, or until the lease of the leader ends. "


def share(text):
    outside, total = K.words_outside(text)
    return outside / max(1, total)


@pytest.mark.parametrize("text", [
    "cheap cache " * 40, "cheap cache, fast lease, " * 30, "\n".join(f"https://a.example/page-{i}" for i in range(20)), "Home > About > Login > Next > " * 12, "tags: cache, lease\n" * 20, "#cache #fast_lease " * 20,
    "Acme disk 40GB refurb\nAcme kit 3x sale\n" * 10, "Acme disk cache - 49.99 add to cart\n" * 10, PROSE[:60] + "cheap cache / " * 40, "Our fast cache is the best lease for every fast cache user.\n" * 6, "Fast cache fast cache now. Fast cache fast cache online! " * 8,
])
def test_spam(text):
    assert share(text) > 0.5


@pytest.mark.parametrize("text", [
    PROSE * 5, "## How to restart\n" + "\n".join(f"{i}. Stop node-{i}." for i in range(1, 30)), "- The leader sends every write to the followers.\n- A lease ends when its holder is silent.\n- Each epoch has one number.\n- Old logs are removed after a snapshot.", "Lease: The right of a leader to write.\nQuorum: More than half of the nodes.\nEpoch: The number of an election.",
    PROSE + "\n```\nctl set a b c d e f\n" + "x y z\n" * 40 + "```\n", PROSE + "\n" + "cache.size = 40\n" * 9, PROSE * 3 + "\nSee also:\nhttps://a.example/x\nhttps://a.example/y", "",
])
def test_honest_pages(text):
    assert share(text) <= 0.5


def test_fit_against_a_plain_regression(spark):
    d = spark.createDataFrame([(1, 10, [(4, 1), (2, 2), (1, 2)]), (2, 3, [(1, 3)]), (3, 0, [])], "doc_id long, words int, spectrum array<struct<f:int,c:int>>")
    got = {r.doc_id: r for r in K.fit_curves(d).collect()}
    x = [math.log(1.0), math.log(1 + 1.5), math.log(3 + 1.5)]
    y = [math.log(4), math.log(2), 0.0]
    mx, my = sum(x) / 3, sum(y) / 3
    slope = sum((a - mx) * (b - my) for a, b in zip(x, y)) / sum((a - mx) ** 2 for a in x)
    assert abs(got[1].slope - slope) < 1e-9 and got[2].slope == 0.0 and 3 not in got


def test_flags(spark):
    rows = [(i, (PROSE + f"Write {i} took {i} ms. ") * (2 + i % 3), None, "2026-01-01 00:00:00") for i in range(60)]
    rows += [(100, "cheap cache " * 60, "en", "2026-01-01 00:00:00"), (101, "", None, None), (102, None, None, None), (None, "x", None, None), (103, "cheap cache " * 60, None, "2026-01-01 00:00:00"), (103, PROSE * 2, None, "2026-01-02 00:00:00"), (104, "?!", None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, s string").selectExpr("*", "cast(s as timestamp) as fetched_at", "1 as words")
    got = {r.doc_id: r for r in K.flag_pages(K.scan_pages(d)).collect()}
    assert [k for k, r in got.items() if r.spam] == [100] and 102 not in got and 101 not in got
    assert K.flag_pages(K.scan_pages(d.limit(0))).count() == 0


@pytest.mark.parametrize("spam", [6, 60, 240])
def test_spam_among_peers_changes_no_flag(spark, spam):
    """Keyword pages of one language and length are flagged however many of them there are."""
    bad = "cheap cache and fast lease for the best store, " * 8
    rows = [(i, (PROSE + f"Write {i} took {i} ms. ") * 2, None) for i in range(60)] + [(1000 + i, bad + f"buy item {i}, ", None) for i in range(spam)]
    d = spark.createDataFrame(rows, "doc_id long, text string, fetched_at timestamp")
    got = {r.doc_id: r for r in K.flag_pages(K.scan_pages(d)).collect()}
    assert len({(r.lang, int(math.log2(r.words))) for r in got.values()}) == 1
    assert {k for k, r in got.items() if r.spam} == set(range(1000, 1000 + spam))


def test_spam_without_any_prose(spark):
    d = spark.createDataFrame([(i, f"cheap cache and fast lease for the store {i}, " * 6, None) for i in range(40)], "doc_id long, text string, fetched_at timestamp")
    assert K.flag_pages(K.scan_pages(d)).where("spam").count() == 40


def test_divergence():
    """Against the definition over all words, the unlisted ones as one."""
    usage = {"the": 0.3, "a": 0.2, "lease": 0.1}
    counts = Counter({"the": 2, "lease": 1, "cheap": 5})
    p = {"the": 2 / 8, "a": 0.0, "lease": 1 / 8, None: 5 / 8}
    q = {**usage, None: 0.4}
    half = lambda x, y: sum(x[w] * math.log2(2 * x[w] / (x[w] + y[w])) for w in x if x[w])
    assert abs(K.divergence(counts, usage, 0.6) - (half(p, q) + half(q, p)) / 2) < 1e-12
    assert K.divergence(Counter({"x": 3}), {}, 0.0) == 0.0 and abs(K.divergence(Counter({"the": 1}), {"the": 1.0}, 1.0)) < 1e-12


def test_the_curve_decides(spark):
    """Prose whose sentences have no full stops reads like a list, but its words are those of prose
    of its language and length: it is no spam.  Without the flag it would be."""
    rng = random.Random(3)
    parts = ["the leader sends every write to the followers", "a follower that is down asks for the log", "the lease of the leader ends after a while", "each write waits until the log is stored", "it answers when most of the followers have the write", "an old log is removed after a snapshot"]
    rows = [(i, " ".join(f"{rng.choice(parts).capitalize()} in round {rng.randint(1, 99)}." for _ in range(14)), None) for i in range(80)]
    rows += [(100 + i, "\n".join(f"{rng.choice(parts)} in round {rng.randint(1, 99)}" for _ in range(14)), None) for i in range(5)]
    rows += [(200 + i, "\n".join(f"cheap cache and best lease for the store {rng.randint(1, 99)}, buy log online" for _ in range(14)), None) for i in range(5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, fetched_at timestamp")
    pages = K.scan_pages(d)
    assert {r.doc_id for r in K.flag_pages(pages).where("spam").collect()} == set(range(200, 205))
    assert {r.doc_id for r in pages.where("outside > 0.5").collect()} == {*range(100, 105), *range(200, 205)}
    assert {r.doc_id for r in K.flag_pages(pages, spread=1e9).where("spam").collect()} == set()


def test_p8_query(spark, small):
    from corpusmill.llm.queries import REGISTRY

    got = REGISTRY.queries["p8_found"](spark, small)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert got.columns == ["doc_id"] and {r.doc_id for r in got.collect()} <= {k for k, t in texts.items() if t and share(t) > 0.5} and not got.isEmpty()
