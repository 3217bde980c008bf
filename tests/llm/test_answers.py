"""Defects of prompt-response pairs."""

import random

import pytest

from corpusmill.llm import answers as A

Q = "How does the cache handle a stale lease?"
COMPLETE = "The cache drops the stale lease and asks the leader for a new one."


@pytest.mark.parametrize("answer, defect", [
    (None, "empty"), ("", "empty"), ("  ​", "empty"), ("<p></p>", "empty"), ("**Answer:** ", "empty"), ("n/a", "empty"), ("```\n```", "empty"), ("(no answer)", "empty"),
    ("No.", None), ("250 ms", None), ("Version 3.2 and later.", None), (COMPLETE, None), (COMPLETE + " [3]", None), ("It has two parts:\n- the lease\n- the leader", None), ("Run this.\n```\nctl set\n```", None),
    ("The cache drops the stale lease and asks the", "truncated"), ("The cache drops the lease,", "truncated"), ("Run this.\n```\nctl set --", "truncated"), ("Steps:\n1. stop it\n2.", "truncated"),
    (Q, "copies_question"), (Q.upper(), "copies_question"), ("You asked: " + Q, "copies_question"), (Q + " " + Q, "copies_question"), ("How does the cache handle stale lease", "copies_question"), (f"Question: {Q}\nAnswer: {Q}", "copies_question"),
    (Q + "\n" + COMPLETE, None), ("Der Cache verwirft die alte Sperre und fragt den Leader nach einer neuen.", "wrong_language"), (COMPLETE + " “Der Cache verwirft die Sperre.” " + COMPLETE, None),
])
def test_pair_checks(answer, defect):
    assert A.check_pair(Q, answer) == defect


def test_asked_languages():
    german = "Der Cache verwirft die alte Sperre und fragt den Leader nach einer neuen."
    assert A.check_pair(Q + " Answer in German, please.", german) is None
    assert A.check_pair("Was passiert, wenn der Leader ausfällt?", german) is None
    assert A.check_pair(None, german) is None


def test_copies_of_any_number_and_length():
    assert all(A.check_pair(Q, " ".join([Q] * n)) == "copies_question" for n in (4, 5, 40))
    long = " ".join(f"word{i}" for i in range(20_000))
    assert A.check_pair(long, long + " and more") == "copies_question"
    assert A.check_pair(long, long[: len(long) // 2] + " " + COMPLETE) is None


def test_templates_reveal_refusals(spark):
    rows, judged = [], []
    for i in range(12):
        rows.append((f"r{i}", f"What about topic {i}?", f"Kindly ask somebody else about this matter, number {i}. Thank you.", None))
        judged.append((f"r{i}", 0 if i == 3 else 1))
        rows.append((f"h{i}", f"Where is item {i}?", f"We observed that the shelf holds item {i} in the hall.", None))
        judged.append((f"h{i}", 1 if i == 0 else 0))
    rows += [("x", None, None, None), (None, "a", "b", None), ("r0", "What about topic 0?", "", "2020-01-01 00:00:00")]
    d = spark.createDataFrame(rows, "request_id string, q string, a string, s string")
    checks = A.check_pairs(d.selectExpr("*", "cast(s as timestamp) as stamp_"), "request_id", "q", "a", "stamp_")
    labels = spark.createDataFrame(judged, "request_id string, refused int")
    got = {r.request_id: r.defect for r in A.pair_defects(checks, labels).collect()}
    assert {k for k, v in got.items() if v == "refusal"} == {f"r{i}" for i in range(1, 12)}
    assert got["x"] == "empty" and got["r0"] == "empty" and not any(k.startswith("h") for k in got)
    assert A.pair_defects(checks.limit(0), labels.limit(0)).count() == 0


def test_clusters_are_verified(spark):
    o = ["a b c d e f g h i j k l m n o p", "a b c d e f g h i j k l m n o p q", "z y x w v u t s r q p o n m l k", "a b"]
    d = spark.createDataFrame([(x,) for x in o], "opening string")
    got = {r.opening: r.cluster for r in A.cluster_openings(d, bands=32, rows=1).collect()}
    assert got[o[0]] == got[o[1]] == o[0] and got[o[2]] == o[2] and got[o[3]] == o[3]


def test_clusters_with_production_parameters(spark):
    """Sentences that differ by a word meet, also over a third one; others that share words don't."""
    core = "i can't answer that question"
    refusals = [core, f"unfortunately {core}", f"sorry {core}", f"{core} now", "zu dieser frage finde ich leider in der sammlung nichts", "zu dieser frage finde ich leider in der sammlung wenig"]
    others = ["the cache drops the stale lease and asks the leader", "the cache keeps the stale page and tells the follower"]
    d = spark.createDataFrame([(x,) for x in refusals + others], "opening string")
    got = {r.opening: r.cluster for r in A.cluster_openings(d).collect()}
    assert {got[x] for x in refusals[:4]} == {core} and {got[x] for x in refusals[4:]} == {refusals[4]}
    assert all(got[x] == x for x in others)


def test_large_buckets_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 3)
    d = spark.createDataFrame([(f"w{i} this matter is left to somebody else in the house",) for i in range(11)], "opening string")
    assert A.cluster_openings(d).select("cluster").distinct().count() == 1


def test_variants_make_one_template(spark):
    """Each wording has one prompt, only their cluster has enough; one prompt's variants don't."""
    words = ["sadly", "truly", "surely", "well"]
    rows = [(f"r{i}", f"What about {i}?", f"{w} kindly ask somebody else about this whole matter today.", None) for i, w in enumerate(words)]
    rows += [(f"s{i}", "What about it?", f"{w} the notes leave this topic to another team for good.", None) for i, w in enumerate(words)]
    d = spark.createDataFrame(rows, "request_id string, q string, a string, s timestamp")
    checks = A.check_pairs(d, "request_id", "q", "a", "s")
    labels = spark.createDataFrame([(r[0], 1) for r in rows], "request_id string, refused int")
    got = A.refusal_openings(A.response_openings(checks), labels).collect()
    assert len(got) == 4 and {(r.prompts, r.judged, r.refused) for r in got} == {(4, 4, 4)} and all("kindly" in r.opening for r in got)


def _refusing(spark, rows, labels, **options):
    checks = A.check_pairs(spark.createDataFrame(rows, "request_id string, q string, a string, s timestamp"), "request_id", "q", "a", "s")
    labels = spark.createDataFrame(labels, "request_id string, refused int")
    return {r.request_id for r in A.pair_defects(checks, labels).collect() if r.defect == "refusal"}


def test_refusals_without_a_list_of_wordings(spark):
    """Invented words decline, wherever they stand in the response, with a slot for the topic; every
    second one is unjudged or judged wrongly.  Without labels, or with nothing that recurs, no
    template is found."""
    things = ["blue lamp", "old brass kettle", "garden wall", "north stair", "copper pipe", "paper crane", "oak table", "tin roof", "iron gate"]
    ways = ["zorb glim nuvo tarsk the {} fenk", "Ombri, zorb glim nuvo tarsk a {} fenk", "zorb glim nuvo tarsk this {} fenk today"]
    preamble = " ".join(f"Point {w} is made first." for w in "one two three four five six seven".split())
    rows = [(f"r{i}", f"Where does the {t} stand?", f"{preamble if i % 2 else ''} {ways[i % 3].format(t)}.", None) for i, t in enumerate(things)]
    rows += [(f"h{i}", f"Is this {t} safe?", f"{preamble} The {t} is safe, the warden of the house looks after it.", None) for i, t in enumerate(things)]
    labels = [(f"r{i}", int(i != 4)) for i in range(9) if i != 2] + [(f"h{i}", int(i == 3)) for i in range(9)]
    assert _refusing(spark, rows, labels) == {f"r{i}" for i in range(9)}
    assert _refusing(spark, rows, labels[:0]) == set()
    assert _refusing(spark, rows[:2] + rows[9:], labels) == set()


def test_without_clusters_rows_are_lost(spark, monkeypatch):
    rows = [(f"r{i}", f"What about {i}?", f"{w} kindly ask somebody else about this whole matter today.", None) for i, w in enumerate(["sadly", "truly", "surely", "well"])]
    labels = [(r[0], 1) for r in rows]
    assert len(_refusing(spark, rows, labels)) == 4
    monkeypatch.setattr(A, "cluster_openings", lambda openings: openings.selectExpr("opening", "opening as cluster"))
    assert _refusing(spark, rows, labels) == set()


def test_recall_of_the_clusters(spark):
    """Verified links against brute force over word sets, production parameters."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    openings = []
    for _ in range(60):
        core = rng.sample(vocabulary, rng.randint(4, 14))
        for _ in range(8):
            said = [w for w in core if rng.random() > 0.05] + ([rng.choice(vocabulary)] if rng.random() < 0.3 else [])
            openings.append(" ".join(dict.fromkeys(said)))
    openings = sorted({o for o in openings if o})
    sets = [frozenset(o.split()) for o in openings]
    got = {r.opening: r.cluster for r in A.cluster_openings(spark.createDataFrame([(o,) for o in openings], "opening string")).collect()}
    true = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    met = sum(got[openings[a]] == got[openings[b]] for a, b in true)
    assert len(true) > 300 and met >= 0.99 * len(true)


def test_topic_words(spark):
    """Words of the prompts are masked, by rates; a null question and answer take no part."""
    rows = [(f"r{i}", f"What limits the {w}?", f"Sorry, nothing limits the {w} here.", None) for i, w in enumerate(["gate", "wall", "lamp"])] + [("n", None, None, None)]
    checks = A.check_pairs(spark.createDataFrame(rows, "request_id string, q string, a string, s timestamp"), "request_id", "q", "a", "s")
    assert {r.word for r in A.topic_words(checks).collect()} == {"what", "limits", "the", "gate", "wall", "lamp"}
    assert {r.opening for r in A.response_openings(checks).collect()} == {"nothing here"}


def test_p3_query(spark, small):
    from corpusmill.llm.queries import REGISTRY

    got = REGISTRY.queries["p3_found"](spark, small)
    rows = got.collect()
    assert got.columns == ["request_id", "defect"] and len({r.request_id for r in rows}) == len(rows) and rows
    assert {r.defect for r in rows} <= {"empty", "truncated", "refusal", "copies_question", "wrong_language"}
