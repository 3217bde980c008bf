"""Fixed values, worked examples and edge cases of the operators."""

import random
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import jsonfix
from corpusmill.functions import text as T
from corpusmill.operators import chunking as C
from corpusmill.operators import cleanup as CL
from corpusmill.operators import intervals as I
from corpusmill.operators import metrics as M
from corpusmill.operators import retrieval as V
from corpusmill.operators import services as SV
from corpusmill.operators import upsert as U
from corpusmill.operators import validate as VA
from corpusmill.operators.ordering import global_row_number
from corpusmill.operators.shred import _load, _load_deep, shred, shred_text

RANKED = "query_id string, item_id string, rank int"
GRADED = "query_id string, item_id string, grade double, is_soft boolean, is_strict boolean"


def metrics(spark, ranked, graded, k):
    r = spark.createDataFrame([("q", i, n + 1) for n, i in enumerate(ranked)], RANKED)
    g = spark.createDataFrame([("q", i, grade, grade >= 0.5, strict) for i, grade, strict in graded], GRADED)
    return M.ranking_metrics(r, g, k).first()


def test_repeats_are_dropped_before_the_cut(spark):
    m = metrics(spark, ["a", "a", "b"], [("a", 1.0, True), ("b", 0.5, False)], 3)
    assert m.recall_soft == 1.0 and m.num_relevant_soft == 2 and abs(m.ndcg - 1.0) < 1e-12
    m = metrics(spark, ["a", "a", "a"], [("a", 1.0, True)], 3)
    assert (m.recall_soft, m.num_relevant_soft, m.ndcg) == (1.0, 1, 1.0)


def test_reciprocal_rank(spark):
    m = metrics(spark, ["x", "b"], [("b", 1.0, False)], 2)
    assert m.rr_soft == 0.5 and m.first_rank_soft == 2 and m.rr_strict == 0.0 and m.first_rank_strict is None
    assert metrics(spark, ["b", "a"], [("a", 1.0, True), ("b", 0.5, False)], 2).ndcg < 1.0


def test_lists_without_items(spark):
    m = metrics(spark, [], [("a", 1.0, True)], 3)
    assert (m.recall_soft, m.rr_soft, m.ndcg) == (0.0, 0.0, 0.0)


def test_weighted_means(spark):
    d = spark.createDataFrame([(1.0, 1), (0.5, 2), (0.0, 3), (0.0, 4)], "s double, r int")
    assert round(d.agg(M.rank_weighted_mean(F.col("s"), F.col("r"))).first()[0], 3) == 0.6
    d = spark.createDataFrame([("g", None, 1), ("g", 1.0, 2)], "g string, s double, r int")
    assert d.agg(M.rank_weighted_mean(F.col("s"), F.col("r"))).first()[0] == 1.0
    assert abs(d.agg(M.rank_weighted_mean_all(F.col("s"), F.col("r"))).first()[0] - 1 / 3) < 1e-12
    assert M.reranked_weighted_mean(d, "g", "s", "r").first()["weighted"] == 1.0


def test_histogram_quantile(spark):
    d = spark.createDataFrame([(2, 2, 0), (0, 0, 0), (0, 0, 3)], "a long, b long, c long")
    got = [r[0] for r in d.select(M.histogram_quantile([10.0, 20.0], [F.col("a"), F.col("b"), F.col("c")], 0.75)).collect()]
    assert got == [15.0, None, 20.0]


def test_dense_top_k_against_brute_force(spark):
    rng = random.Random(1)
    vectors = [(i, [rng.random() for _ in range(4)]) for i in range(60)] + [(100, None), (101, [1.0])]
    d = spark.createDataFrame(vectors, "item_id long, vector array<double>")
    q = d.where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")
    got = {(r.query_id, r.rank): r.item_id for r in V.dense_top_k(d, q, 3).collect()}
    good = vectors[:60]
    for i in (0, 20, 40):
        best = sorted(good, key=lambda v: (-round(sum(a * b for a, b in zip(v[1], good[i][1])), 6), v[0]))[:3]
        assert [got[i, k + 1] for k in range(3)] == [b[0] for b in best]
    assert V.dense_top_k(d, q.limit(0), 3).count() == 0


def test_sparse_top_k_against_the_scores(spark, monkeypatch):
    """Blocks of queries, ties, items with a token twice, weights of both signs and nulls; the pairs of
    queries and items are never rows."""
    import random

    rng = random.Random(5)
    monkeypatch.setattr(V, "QUERY_BLOCK", 7)
    monkeypatch.setattr(V, "ITEMS_AT_ONCE", 16)
    for signs in ([1.0, 2.0], [-1.0, 0.0, 1.5]):
        q = spark.createDataFrame([(f"q{i:02d}", f"t{t}", rng.choice(signs)) for i in range(20) for t in rng.sample(range(30), 4)], "query_id string, token_id string, weight double")
        d = spark.createDataFrame([(f"d{i:03d}", f"t{rng.randrange(40)}", rng.choice(signs)) for i in range(150) for _ in range(12)], "item_id string, token_id string, weight double").repartition(3)
        nulls = spark.createDataFrame([(None, "t1", 1.0), ("n", None, 1.0), ("n", "t1", None)], "item_id string, token_id string, weight double")
        got = V.sparse_top_k(q.unionByName(nulls.withColumnRenamed("item_id", "query_id")), d.unionByName(nulls), 5)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, V.top_k(V.sparse_scores(q, d), 5).select("query_id", "item_id", "score", "rank").collect()))
    none = V.sparse_top_k(q.limit(0), d, 5)
    assert none.dtypes == got.dtypes and none.count() == 0 and V.sparse_top_k(q, d.limit(0), 5).count() == 0


def test_sparse_search_writes_no_pairs(spark, small, monkeypatch):
    from corpusmill.plans.retrieval import REGISTRY

    monkeypatch.setattr(V, "sparse_scores", None)
    assert REGISTRY.queries["jon16_sparse_dot"](spark, small).columns == ["query_id", "item_id", "score", "rank"]


def test_every_capture_is_searched(spark, small):
    from corpusmill.plans.retrieval import REGISTRY, _query_tokens

    asked = {r.query_id for r in _query_tokens(spark, small).select("query_id").distinct().collect()}
    got = {r.query_id for r in REGISTRY.queries["jon16_sparse_dot"](spark, small).select("query_id").distinct().collect()}
    assert len(asked) > 20 and got <= asked and len(got) > 0.9 * len(asked)


@pytest.mark.parametrize("signs", [[1.0, 2.0], [0.25, 1.5], [-1.0, 0.0, 1.5]])
@pytest.mark.parametrize("few, share", [(0, 0.0), (0, 2.0), (40, 0.05), (10**9, 2.0)])
def test_sparse_products(monkeypatch, signs, few, share):
    """Tokens as dense rows, one by one and cell by cell give the same; the cells kept hold each row's best."""
    monkeypatch.setattr(V, "FEW", few)
    monkeypatch.setattr(V, "DENSE_SHARE", share)
    rng, n, m, k = np.random.default_rng(7), 30, 400, 5
    ask, items = (rng.choice(signs, (n, 20)) * (rng.random((n, 20)) < 0.4), rng.choice(signs, (m, 25)) * (rng.random((m, 25)) < 0.5))
    shared = (ask[:, :20] != 0).astype(int) @ (items[:, :20] != 0).T.astype(int) > 0
    q, t = np.nonzero(ask)
    got = pa.table({"_n": q + 100, "_t": t, "wq": ask[q, t]})
    total, parts, whole, heaviest = V._query_parts(got, 100, 8)
    t, i = np.nonzero(items.T)
    edges = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    positive = min(signs) > 0
    assert total == n and len(parts) == 4 and (heaviest is not None) == positive and whole == (signs == [1.0, 2.0])
    for part in parts:
        low, rows = part[0], part[1]
        scores, met = np.full((rows, m), 9.0), None if positive else np.zeros((rows, m), bool)
        V._part_scores(part, (t[edges], np.append(edges, len(t)), i, items[i, t]), scores, met)
        assert np.allclose(scores, ask[low : low + rows] @ items[:, :20].T) and (met is None or (met == shared[low : low + rows]).all())
        scores[~shared[low : low + rows]] = -np.inf
        least = np.where(np.arange(rows) % 2, 2.0, -np.inf)
        q, c, s = V._part_best(scores, least, k, 6, 0.0 if positive else -np.inf)
        for r in range(rows):
            want = sorted((-round(x, 6), j) for j, x in enumerate(scores[r].tolist()) if x > least[r])[:k]
            assert sorted(zip((-s[q == r]).tolist(), c[q == r].tolist()))[:k] == want


def test_fusion(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, item_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, item_id string, rank int")
    got = {r.item_id: r.score for r in V.rank_fusion([a, b], 10).collect()}
    assert got == {"y": round(1 / 2 + 1 / 3, 6), "x": 0.5, "z": round(1 / 3, 6)}
    assert [r.item_id for r in V.rank_fusion([a, b], 10, threshold=0.6).collect()] == ["y"]


def test_uuid5_and_hashes(spark):
    names = ["a", "ü", "", "chunk-1"]
    d = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in d.select(U.uuid5(str(uuid.NAMESPACE_DNS), F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, v string, t int")
    new = spark.createDataFrame([(1, "A", 1), (2, "B", 4), (3, "C", None), (3, "C", None)], "k int, v string, t int")
    assert {r.k: r.v for r in U.upsert(old, new, ["k"], "t").collect()} == {1: "A", 2: "b", 3: "C"}
    assert {r.k: r.v for r in U.insert_ignore(old, new, ["k"]).collect()} == {1: "a", 2: "b", 3: "C"}
    assert U.insert_ignore(old, new.limit(0), ["k"]).count() == 2


def test_change_classes(spark):
    old = spark.createDataFrame([("a", "1", "m"), ("b", "1", "m"), ("c", "1", "m")], "k string, print string, meta string")
    new = spark.createDataFrame([("a", "1", "m"), ("b", "2", "m"), ("c", "1", None), ("d", "1", "m"), (None, "1", "m")], "k string, print string, meta string")
    assert {r.k: r.action for r in U.classify_changes(old, new, "k").collect()} == {"a": "skip", "b": "skip_and_log", "c": "update", "d": "insert"}


def test_drain_retries_and_stops(spark):
    state = spark.createDataFrame([(1, None, U.STAGES[0], "pending", 0), (2, None, U.STAGES[0], "failed", 1)], "request_id int, received_at timestamp, stage string, status string, attempts int")
    done = U.drain(state, U.STAGES[0], lambda todo: todo.select("request_id", F.lit(True).alias("ok")))
    assert {(r.status, r.attempts) for r in done.collect()} == {("completed", 1), ("completed", 2)}
    with pytest.raises(RuntimeError):
        U.drain(state, U.STAGES[0], lambda todo: todo.select("request_id", F.lit(False).alias("ok")))


def test_intervals(spark):
    d = spark.createDataFrame([("g", 1, 3), ("g", 2, 5), ("g", 8, 9), ("g", None, 4), ("h", 7, 6), ("h", 1, 1)], "g string, start int, end int")
    assert sorted(map(tuple, I.merge(d, "g").collect())) == [("g", 1, 5), ("g", 8, 9), ("h", 1, 1)]
    parents = spark.createDataFrame([("g", 0, 10), ("z", 1, 2)], "g string, start int, end int")
    assert sorted(map(tuple, I.subtract(parents, d, "g").select("g", "start", "end").collect())) == [("g", 0, 0), ("g", 6, 7), ("g", 10, 10), ("z", 1, 2)]
    assert I.merge(d.limit(0), "g").count() == 0


def test_interval_joins_against_brute_force(spark):
    rng = random.Random(3)
    iv = [("g", i, s := rng.randrange(300), s + rng.randrange(90)) for i in range(40)]
    d = spark.createDataFrame(iv, "g string, id int, start int, end int")
    want = {(a[1], b[1]) for a in iv for b in iv if a[2] <= b[3] and b[2] <= a[3]}
    assert {(r.a_id, r.b_id) for r in I.overlapping(d, d, "g", 16).collect()} == want
    assert I.overlapping(d, d, "g", 16).count() == len(want)
    p = spark.createDataFrame([("g", x) for x in range(0, 400, 7)], "g string, x int")
    assert {(r.x, r.id) for r in I.containing(p, d, "g", "x", 16).collect()} == {(x, i) for x in range(0, 400, 7) for _, i, s, e in iv if s <= x <= e}


def test_packing_rules():
    assert C.pack_windows([5, 5, 5, 5, 5, 5], 15, 0.0) == [(0, 3), (3, 6)]
    assert C.pack_windows([100], 15, 0.5) == [(0, 1)]
    assert C.pack_windows([], 15, 0.5) == []
    assert C.pack_windows([100, 1, 1], 15, 0.5)[0] == (0, 1)
    w = C.pack_windows([5] * 10, 15, 0.34)
    assert all(b[0] < a[1] for a, b in zip(w, w[1:])) and w[-1][1] == 10
    assert all(b[0] > a[0] for a, b in zip(w, w[1:]))


def test_chunking_of_documents(spark):
    d = spark.createDataFrame([("a", 1, "One two three. Four five."), ("a", 2, " "), ("a", 3, "Six seven eight nine."), ("b", 1, None)], "doc_id string, page int, text string")
    got = C.fixed_chunks(C.sentence_units(d), 4, 0.0).orderBy("chunk_index").collect()
    assert [(r.text, r.page_start, r.page_end) for r in got] == [("One two three. Four five.", 1, 1), ("Six seven eight nine.", 3, 3)]


def test_section_spans(spark):
    s = [(1, "r", None, 0, 100), (1, "a", "r", 10, 20), (1, "b", "r", 30, 40)]
    d = spark.createDataFrame(s, "doc_id long, id string, parent string, start long, end long")
    assert [tuple(r)[1:] for r in C.section_tree(d).orderBy("start").collect()] == [("r", 0, 9, "leading"), ("a", 10, 29, "leaf"), ("b", 30, 40, "leaf"), ("r", 41, 100, "trailing")]


def word(text, top, x0=0.0, size=10.0):
    return {"text": text, "top": top, "x0": x0, "size": size, "bottom": top + size}


def test_page_cleanup(spark):
    page = [word("Header", 1), word("Text", 50), word("12", 49, 40, 5.0), word("here.", 50, 60), word("Figure", 70), word("1", 70, 50, 9.0), word("caption", 82), word("End.", 200)]
    rules = CL.PageRules(drop_lines=(("prefix", "Header", "top"),), blocks=(CL.BlockRule(CL.TextAnchor(r"^Figure \d"), most_lines=2, stops=(("gap", 1.5),), references=(("gap", "median_gap", 5.0),)),), terms={"End": "Fin"})
    assert CL.clean_words(page, 500.0, rules) == "Text here. Fin."
    two = [word("left", 10, 0), word("right", 10, 300), word("down", 30, 0)]
    assert CL.clean_words(two, 500.0, CL.PageRules(columns_at=200.0)) == "left down right"
    d = spark.createDataFrame([("d", 1, None, 100.0)], f"doc_id string, page int, words {CL.WORD}, page_height double")
    assert CL.clean_pages(d, rules).first()["clean_text"] == ""


def test_conditions():
    import re

    f = CL.Found(7, {7: 3}, re.search(r"Chapter (\d+)", "Chapter 3"), [1, 2], [{"text": "1", "size": 5.0}, {"text": "note", "size": 8.0}], {"size": 10.0})
    chapter = {"kind": "anchor_capture_int_eq_context", "capture_group": 1}
    two = {"kind": "candidate_line_count_gte", "value": 2}
    three = {"kind": "candidate_line_count_gte", "value": 3}
    digit = {"kind": "word_below_anchor_regex_at_index", "word_index": 0, "pattern": r"^\d+$"}
    small = {"kind": "word_below_anchor_size_lte_at_index", "word_index": 0, "value": 5}
    ratio = {"kind": "all_words_below_anchor_size_ratio_lte", "reference": "size", "value": 0.8, "ignore_first_word_if_matches": r"^\d"}
    assert all(CL.condition(t)(f) for t in (None, chapter, two, digit, small, ratio, {"all": [chapter, two]}, {"any": [three, small]}, {"not": three}, {"not": {"all": [two, {"any": [three]}]}}, {"all": []}))
    bad = [three, {"any": []}, {**chapter, "capture_group": 2}, {**digit, "word_index": 5}, {**small, "value": 4}, {**ratio, "value": 0.7}, {**ratio, "reference": "none"}, {**digit, "word_index": -1}]
    assert not any(CL.condition(t)(f) for t in bad) and not CL.condition(chapter)(CL.Found(8, {7: 3}, f.match, [], [], {})) and not CL.condition(chapter)(CL.Found(7, {7: 3}, None, [], [], {}))
    with pytest.raises(KeyError):
        CL.condition({"kind": "unknown"})


def test_blocks_before_and_after_the_line_rules():
    page = [word("Chapter", 10), word("3", 10, 60), word("running", 22), word("Body", 60), word("text", 60, 60), word("more", 100), word("1", 400, 0, 5.0), word("note", 400, 20, 6.0), word("Chapter", 420), word("9", 420, 60)]
    heads = CL.BlockRule(CL.TextAnchor(r"^Chapter (\d)"), before_lines=True, most_lines=2, when={"kind": "anchor_capture_int_eq_context", "capture_group": 1})
    notes = CL.BlockRule(CL.RuledAnchor(from_share=0.5, width=(50.0, 200.0)), references=(("size", "median_word_font_size_above_anchor", 9.0),), when={"any": [{"kind": "word_below_anchor_regex_at_index", "word_index": 0, "pattern": "^1$"}]})
    ruled = [{"top": 390.0, "x0": 0.0, "x1": 100.0, "linewidth": 1.0}, {"top": 300.0, "x0": 0.0, "x1": 400.0, "linewidth": 1.0}, {"top": None, "x0": 0.0, "x1": 60.0, "linewidth": 1.0}]
    rules = CL.PageRules(blocks=(heads, notes), drop_lines=(("prefix", "more", "any"),), superscript_ratio=0.1, chapter_of={7: 3})
    assert CL.clean_words(page, 500.0, rules, 7, ruled) == "Body text"
    assert CL.clean_words(page, 500.0, rules, 8, []) == "Chapter 3 running Body text 1 note Chapter 9"
    late = CL.PageRules(blocks=(CL.BlockRule(CL.TextAnchor("^Chapter", first=True), most_lines=3),), drop_lines=(("prefix", "running", "any"),), superscript_ratio=0.1)
    assert CL.clean_words(page[:6], 500.0, late) == ""  # the line rules have made one block of it
    lines = CL.PageRules(substitutions=((r"\n", " / "),), superscript_ratio=0.1)
    assert CL.clean_words(page[:5], 500.0, lines) == "Chapter 3 / running / Body text"


def test_text_functions(spark):
    d = spark.createDataFrame([(" a  b\0c ", "it's a WORLD-wide b2b.", "A” b? C. d")], "x string, t string, s string")
    r = d.select(T.collapse(F.col("x")), T.clean_title(F.col("t")), T.sentences(F.lit("One. Two! “Three?” Four")), T.collapse(F.lit(None).cast("string"))).first()
    assert r[0] == "a bc" and r[1] == "It'S A World-Wide B2B" and r[2] == ["One.", "Two!", "“Three?”", "Four"] and r[3] is None
    with pytest.raises(ValueError):
        T.fill_template("{{a}} {{b}}", {"a": F.lit(1)})


def test_json_repair(spark):
    assert jsonfix.repair('```json\n{"label": "a "quoted" word"}\n```') == '{"label":"a \\"quoted\\" word"}'
    assert jsonfix.repair('noise {"a": {"b": "}"}} tail') == '{"a":{"b":"}"}}'
    assert jsonfix.repair('{"label": "good"') == '{"label":"good"}' and jsonfix.repair('```json\n{"a": {"b": 1}\n```') == '{"a":{"b":1}}'
    assert jsonfix.repair('{"why": "he said "no", then left", "label": "bad"}') is None  # a quote before a comma ends a value
    assert jsonfix.repair('{"a "b" c": ["x "y" z", "w"], "n": 1}') == '{"a \\"b\\" c":["x \\"y\\" z","w"],"n":1}'
    assert jsonfix.repair('{"a": "say "hi": there"}') == '{"a":"say \\"hi\\": there"}'
    long = '{"a": "' + 'x " y' * 100_000 + '"}'
    assert len(jsonfix.repair(long)) > 500_000
    assert jsonfix.repair("nothing") is None and jsonfix.repair(None) is None and jsonfix.repair("[1]") is None
    d = spark.createDataFrame([('{"a": 1}',), ('x {"a": 2}',), (None,), ("",)], "t string")
    assert [r[0] for r in d.select(F.get_json_object(jsonfix.tolerant_object(F.col("t")), "$.a")).collect()] == ["1", "2", None, None]


def test_embedding_falls_back_to_single_items(spark):
    def model(texts):
        if "bad" in texts:
            raise ValueError("bad input")
        return SV.hash_embedding(texts)

    d = spark.createDataFrame([(1, "x"), (2, "bad"), (3, None)], "k int, t string").coalesce(1)
    got = {r.k: r for r in SV.embed(d, "k", "t", model).collect()}
    assert got[1].embedding == SV.hash_embedding(["x"])[0] and got[2].error == "bad input" and got[3].error == "no text"


def test_violations(spark):
    d = spark.createDataFrame([(1, 2), (None, 1)], "a int, b int")
    good, bad = VA.split_rejects(d, {"a": F.col("a") > 0, "b": F.col("b") > 1})
    assert good.count() == 1 and bad.first()["violations"] == ["a", "b"]


def test_global_positions(spark):
    d = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = global_row_number(d, ["x"], "n")
    assert got.where("x = n").count() == 1000
    assert global_row_number(d.limit(0), ["x"], "n").count() == 0


def test_shredding_of_odd_json(spark):
    assert shred_text(None) == shred_text("") == shred_text("{") == shred_text("[" * 200_000) == []
    nodes = shred_text('{"a": [1, "{\\"b\\": true}"], "a": null}')
    assert [(n[0], n[1], n[2], n[3], n[4], n[5]) for n in nodes] == [(0, -1, None, 0, "object", None), (1, 0, "a", 0, "array", None), (2, 1, "a", 0, "number", "1"), (3, 1, "a", 1, "object", None), (4, 3, "b", 0, "boolean", "true"), (5, 0, "a", 1, "null", None)]
    d = spark.createDataFrame([("r", '{"x": 1}', "key"), (None, "[]", "k"), ("s", None, "k")], "id string, j string, key string")
    assert [(r.key, r.node) for r in shred(d, "id", ["j"]).collect()] == [("r", -1), ("r", 0), ("r", 1), ("s", -1), ("s", -1)]
    assert shred(d.limit(0), "id", ["j"]).count() == 0


def test_shredding_of_deep_json():
    """200,000 levels are read, whole or not; the stack reader agrees with the parser."""
    deep = "[" * 200_000 + '{"chunk_id": "c"}' + "]" * 200_000
    nodes = shred_text(deep)
    assert len(nodes) == 200_002 and nodes[-1][4:] == ("string", "c") and shred_text(deep[:-1]) == shred_text(deep + "]") == []
    for text in ('{}', '[]', ' [1, -2.5e3, true, null, "a\\"b", {"x": {}, "y": [[], "é"]}] ', '"s"', '0', '{"a": 1, "a": 2}', '[1, NaN]'):
        assert repr(_load_deep(text)) == repr(_load(text))
    for text in ('', '[', '{"a"}', '{"a": }', '[1,]', '{"a": 1,}', '[1] 2', '01', '{a: 1}', '[1 2]', '"x', '[}', '{"a": 1]', "tru"):
        with pytest.raises(ValueError):
            _load_deep(text)


def test_the_latest_delivery_holds_even_without_children(spark, tmp_path):
    from corpusmill.plans import all_queries

    def row(key, day, items, ranker):
        return (key, f"2026-01-0{day} 00:00:00", items, "{}", ranker)

    rows = [row("r1", 1, '[{"chunk_id": "old"}]', '{"weights": {"a": 1}}'), row("r1", 2, "[]", '{"weights": {"b": 2}}'), row("r2", 1, '[{"chunk_id": "old"}]', '{"weights": {"a": 1}}'), row("r2", 2, '[{"chunk_id": "new"', None), row("r3", 1, "[" * 200_000, " ")]
    d = spark.createDataFrame(rows, "request_id string, s string, retrieval_results string, retriever_config string, reranker_config string")
    d.selectExpr("*", "cast(s as timestamp) as stored_at").write.parquet(f"{tmp_path}/request_captures.parquet")
    q = {k: sorted(map(tuple, f(spark, str(tmp_path)).collect())) for k, f in all_queries().queries.items() if k.startswith("p1_")}
    assert q["p1_found"] == [("r1", "reranker_config.weights", 0, "b")] and q["p1_retrieved_items"] == []
    assert q["p1_reranker_weights"] == [("r1", 1, 0, 0, "b", 2.0)]
    assert q["p1_rejects"] == [("r2", "reranker_config", "absent"), ("r2", "retrieval_results", "unreadable"), ("r3", "reranker_config", "absent"), ("r3", "retrieval_results", "unreadable")]


def test_captures_with_odd_deliveries(spark, tmp_path):
    from corpusmill.plans import all_queries

    rows = [
        ("r1", "2026-01-01 00:00:00", '[{"chunkId": " c1 "}, {}, [{"CHUNK_ID": "c2", "x": {"chunk-id": 5}}], {"chunk_id": " "}]', '"{\\"strategy\\": [{\\"kind\\": \\"bm25\\"}]}"', '{"weights": {"a": "0.5", "b": true, "c": null, "d": "x", "e": 1e-3}}'),
        ("r1", "2026-01-02 00:00:00", '[{"chunk_id": "c9"}]', None, '{"weights": [{"name": "n", "value": 2}, {"name": "m", "value": "?"}], "cross_encoder": {"model_name": "big"}}'),
        ("r2", None, '[{"chunk_id": "c1"}', "{}", ""),
        (None, None, '[{"chunk_id": "c1"}]', "{}", ""),
    ]
    d = spark.createDataFrame(rows, "request_id string, s string, retrieval_results string, retriever_config string, reranker_config string").select("*", F.col("s").cast("timestamp").alias("stored_at"))
    first = d.where("s = '2026-01-01 00:00:00'")
    first.unionByName(first).write.parquet(f"{tmp_path}/a/request_captures.parquet")
    p1 = all_queries().queries["p1_found"]
    got = sorted(map(tuple, p1(spark, f"{tmp_path}/a").collect()))
    assert got == [("r1", "reranker_config.weights", 0, "a"), ("r1", "reranker_config.weights", 0, "e"), ("r1", "retrieval_results", 1, "c1"), ("r1", "retrieval_results", 2, "c2"), ("r1", "retrieval_results", 3, "5"), ("r1", "retriever_config.strategy", 0, "bm25")]
    d.write.parquet(f"{tmp_path}/b/request_captures.parquet")
    got = sorted(map(tuple, p1(spark, f"{tmp_path}/b").collect()))
    assert got == [("r1", "reranker_config.cross_encoder", 0, "big"), ("r1", "reranker_config.weights", 0, "n"), ("r1", "retrieval_results", 1, "c9")]
    d.limit(0).write.parquet(f"{tmp_path}/c/request_captures.parquet")
    assert p1(spark, f"{tmp_path}/c").count() == 0


def test_shared_suffix_has_no_longest_length(spark):
    from pyspark.sql import functions as F

    from corpusmill.operators.chunking import shared_suffix

    long = [f"s{i}" for i in range(12)]
    rows = [(["x", *long], [*long, "y"], 12), (long, long, 12), (["a", "b"], ["b", "a"], 1), (["a"], ["b", "a"], 0), ([], ["a"], 0), (None, ["a"], 0)]
    d = spark.createDataFrame(rows, "a array<string>, b array<string>, k int")
    assert d.where(shared_suffix(F.col("a"), F.col("b")) != F.col("k")).count() == 0


def test_dense_top_k_over_several_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(V, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(4)
    vectors = np.round(rng.normal(size=(40, 4)), 1)
    vectors[7] = vectors[9]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "item_id long, vector array<double>")
    q = d.where("item_id < 11").withColumnRenamed("item_id", "query_id")
    got = {(r.query_id, r["rank"]): (r.item_id, r.score) for r in V.dense_top_k(d, q, 5).collect()}
    scores = np.round(vectors[:11] @ vectors.T, 6) + 0.0
    for i in range(11):
        best = sorted(range(40), key=lambda j: (-scores[i, j], j))[:5]
        assert [got[(i, k + 1)][0] for k in range(5)] == best
    assert len(got) == 55


def test_joins_beyond_the_broadcast_bound(spark):
    from corpusmill.session import join_hot

    d = spark.createDataFrame([("hot", i) for i in range(50)] + [("b", 1), (None, 2)], "k string, v int")
    s = spark.createDataFrame([("hot", 7), ("b", 8), ("c", 9)], "k string, w int")
    want = sorted(map(tuple, join_hot(d, s, "k").select("k", "v", "w").collect()))
    assert sorted(map(tuple, join_hot(d, s, "k", limit=1, salts=4).select("k", "v", "w").collect())) == want and len(want) == 51


def test_sweep_deletes_the_tables(spark):
    """By name here, so that tables of other tests stay."""
    from corpusmill import session

    mine, other = session.materialise(spark.range(3).toDF("x"), "swept"), session.materialise(spark.range(3).toDF("x"), "kept")
    session.sweep(spark, "swept")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{session.shared_folder(spark)}/corpusmill")
    names = [s.getPath().getName() for s in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)]
    assert other.count() == 3 and mine.columns == ["x"] and not any(n.startswith("swept-") for n in names) and any(n.startswith("kept-") for n in names)


def test_exact_objects(spark):
    from corpusmill.operators.validate import exact_objects

    texts = {'[{"a": "x", "n": 1, "f": true}]': True, '[{"n": -2.5e3, "a": "x", "f": false}, {"a": "y", "n": 0, "f": true}]': True, "[]": True, '[{"a": " ", "n": 1, "f": true}]': False, '[{"a": "x", "n": "1", "f": true}]': False, '[{"a": "x", "n": 1}]': False}
    texts |= {'[{"a": "x", "n": 1, "f": true, "z": 0}]': False, '[{"a": null, "n": 1, "f": true}]': False, '[1]': False, '["x"]': False, "{}": False, "[{": False, "": False, '[null]': False, '[{"a": {"b": 1}, "n": 1, "f": true}]': False}
    d = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = {r.t: r.ok for r in d.select("t", exact_objects(F.col("t"), {"a": "text", "n": "number", "f": "flag"}).alias("ok")).collect()}
    assert got == {**texts, None: False}
