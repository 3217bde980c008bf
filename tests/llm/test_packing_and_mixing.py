"""Tokens, containers and mixes."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import mixing as M
from corpusmill.llm import packing as P
from corpusmill.llm import tokens as T

needs_tokenizer = pytest.mark.skipif(not os.path.exists(T.DEFAULT_TOKENIZER), reason="no tokenizer file")


@needs_tokenizer
def test_fast_count_is_exact():
    import base64

    import tiktoken

    with open(T.DEFAULT_TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("x", pat_str=T.BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    count = T.counter()
    texts = ["", " ", "a  b", "a b", " lead", "trail ", "a \n b", "a\n b\n", "x  y z", "it's we'll  no", "é ü 北京 😀 b", "tab\t a b", "<|endoftext|> a", "1 22 333 a1b2"]
    rng = random.Random(5)
    texts += ["".join(rng.choice("ab .,'\n\t 1é") for _ in range(rng.randrange(60))) for _ in range(500)]
    assert [count(t) for t in texts] == [len(encode(t)) for t in texts]


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_exactly_the_demand(seed):
    rng = random.Random(seed)
    demand = Counter(min(64, max(1, int(rng.expovariate(1 / 12)))) for _ in range(3000))
    if seed == 3:
        demand = Counter({64: 5, 33: 7, 1: 2})
    p = P.plan(dict(demand), 64)
    held = Counter()
    for filling, k, _ in p.configurations:
        assert sum(s * n for s, n in filling.items()) <= 64 and k > 0
        for s, n in filling.items():
            held[s] += n * k
    assert held == demand
    bound = max(-(-sum(s * n for s, n in demand.items()) // 64), sum(n for s, n in demand.items() if s > 32))
    assert p.containers <= bound * 1.02 + 2
    starts = sorted((first, first + k) for _, k, first in p.configurations)
    assert starts[0][0] == 0 and all(a[1] == b[0] for a, b in zip(starts, starts[1:]))


@pytest.mark.parametrize("seed", range(5))
def test_cover_and_rounding_against_best_fit(seed):
    """Many lengths: the fractional cover holds the demand and is within 1 % of the size bound, and
    the packing needs no more containers than best-fit alone."""
    rng = random.Random(seed)
    demand = Counter(min(512, max(1, int(rng.lognormvariate(4.6, 0.9)))) for _ in range(20_000))
    cover = P.solve_configurations(demand, 512)
    held = Counter()
    for filling, x in cover.configurations:
        assert sum(s * n for s, n in filling.items()) <= 512
        for s, n in filling.items():
            held[s] += n * x
    size = sum(s * n for s, n in demand.items()) / 512
    assert all(abs(held[s] - n) < 1e-6 * n for s, n in demand.items())
    assert size <= cover.bound + 1e-6 and cover.containers <= 1.01 * size and cover.gap <= 0.01
    assert P.plan(demand, 512).containers <= sum(k for _, k in P.best_fit(demand, 512))


@pytest.mark.parametrize("seed", range(3))
def test_the_program_beats_best_fit_on_triplets(seed):
    """Every container can be filled by three items, which best-fit misses."""
    rng = random.Random(seed)
    demand, count = Counter(), 400
    for _ in range(count):
        a, b = rng.randrange(190, 250), rng.randrange(125, 190)
        demand.update([a, b, 512 - a - b])
    p = P.plan(demand, 512)
    assert count <= p.containers <= 1.02 * count < 1.04 * count < sum(k for _, k in P.best_fit(demand, 512))
    assert abs(p.bound - count) < 1e-6 and p.fractional <= 1.02 * count


def test_knapsack_against_brute_force():
    import itertools

    import numpy as np

    sizes, prices = np.array([3, 4, 7]), np.array([2.0, 3.1, 5.0])
    filling, value = P._knapsack(prices, 17, sizes)
    best = max(sum(n * p for n, p in zip(c, prices)) for c in itertools.product(range(6), range(5), range(3)) if sum(n * s for n, s in zip(c, sizes)) <= 17)
    assert abs(value - best) < 1e-9 and sum(s * n for s, n in filling.items()) <= 17


@pytest.mark.parametrize("capacity, classes", [(100, 512), (2048, 512), (1000, 64)])
def test_containers(spark, capacity, classes):
    rng = random.Random(capacity)
    sizes = [(i, rng.choice([0, 1, 7, capacity // 3, capacity - 1, capacity, capacity + 1, 3 * capacity + 5, rng.randrange(1, capacity)])) for i in range(600)]
    d = spark.createDataFrame(sizes + [(1000, None)], "doc_id long, tokens long")
    rows = P.pack(d, "doc_id", capacity, classes).collect()
    load = Counter()
    for r in rows:
        if r.container is not None:
            load[r.container] += r.tokens
    assert max(load.values()) <= capacity
    pieces = Counter()
    for r in rows:
        pieces[r.doc_id] += r.tokens
        assert (r.pieces > 1) == (dict(sizes)[r.doc_id] > capacity)
    assert pieces == Counter(dict(sizes)) + Counter() or {k: v for k, v in pieces.items()} == dict(sizes)
    assert all((r.container is None) == (r.tokens == 0) for r in rows)
    assert sum(load.values()) / capacity / len(load) > 0.9
    assert P.pack(d.limit(0), "doc_id", capacity).count() == 0


def test_pairs_keep_the_tokens():
    rng = random.Random(2)
    for i in range(300):
        a, b = [2 * i, rng.randrange(0, 500), 0, rng.random()], [2 * i + 1, rng.randrange(0, 500), 0, rng.random()]
        before = a[3] * max(1, a[1]) + b[3] * max(1, b[1])
        x, y = M.pair_off(a, b, 1)
        assert x[3] in (0.0, 1.0) and -1e-9 <= y[3] <= 1 + 1e-9
        assert abs(x[3] * max(1, x[1]) + y[3] * max(1, y[1]) - before) < 1e-6


def mixed(spark, docs, targets):
    d = spark.createDataFrame(docs, "doc_id long, tokens long, source string").repartition(7)
    t = spark.createDataFrame(targets, "mix_name string, source string, target_share double, max_repeats int")
    plan = M.mix_plan(d, t)
    chosen = M.select_copies(d, plan)
    return chosen, M.mix_report(plan, chosen)


def test_shares_and_caps(spark):
    rng = random.Random(4)
    docs = [(i, rng.randrange(1, 400), "big" if i % 3 else "small") for i in range(1500)] + [(5000, 10, None), (5001, 0, "big")]
    chosen, report = mixed(spark, docs, [("m", " Big", 0.3, 1), ("m", "small", 0.6, 2), ("m", "none", 0.1, 9), ("n", "small", 1.0, 1)])
    total = sum(t for _, t, _ in docs)
    got = {(r.mix_name, r.source): r for r in report.collect()}
    assert abs(got["m", " Big"].actual_tokens - 0.3 * total) < 500
    small = sum(t for _, t, s in docs if s == "small")
    assert got["m", "small"].reachable == (2 * small >= 0.6 * total)
    assert abs(got["m", "small"].actual_tokens - min(0.6 * total, 2 * small)) < 500
    assert not got["m", "none"].reachable and got["m", "none"].actual_tokens == 0
    assert got["n", "small"].actual_tokens == small and got["n", "small"].most_copies == 1
    assert chosen.groupBy("mix_name", "source", "doc_id").count().where("count > 1").count() == 0
    caps = {r.mix_name: r.m for r in chosen.groupBy("mix_name").agg(F.max("copies").alias("m")).collect()}
    assert caps["m"] <= 2 and caps["n"] == 1


def test_empty_mixes(spark):
    chosen, report = mixed(spark, [(1, 5, "a")], [("m", "b", 1.0, 2), (None, "a", 1.0, 1)])
    assert chosen.count() == 0 and [(r.mix_name, r.reachable) for r in report.collect()] == [("m", False)]


@needs_tokenizer
def test_p6_and_p7_queries(spark, small):
    from corpusmill.llm.queries import REGISTRY

    found = {r.doc_id for r in REGISTRY.queries["p6_found"](spark, small).collect()}
    count = T.counter()
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert found == {r.doc_id for r in docs if count(r.text or "") > 2048}
    assert REGISTRY.queries["p7_found"](spark, small).columns == ["mix_name", "source"]
    names = {(r.mix_name, r.source) for r in spark.read.parquet(f"{small}/mix_targets.parquet").collect()}
    assert {tuple(r) for r in REGISTRY.queries["p7_found"](spark, small).collect()} <= names
