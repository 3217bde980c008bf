"""Filling containers of fixed capacity: a configuration linear program over the length histogram.

Lengths are reduced to a histogram of at most ``classes`` classes.  The program "cover every class
with as few containers as possible" is solved by multiplicative weights: the weights of the classes
price a knapsack, whose best filling is the next configuration.  Every price gives a dual bound, so
the gap of the fractional cover is known.  The cover is rounded to whole containers, what that leaves
goes best-fit into their free room and into further ones, and the documents are dealt to the slots of
the configurations by their rank in their class.  Nothing on the driver grows with the documents.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


@dataclass
class Plan:
    """configurations: class counts, how many containers are filled so, first container's number.
    fractional: containers of the fractional cover; bound: no packing of the classes needs fewer."""

    configurations: list[tuple[dict[int, int], int, int]]
    containers: int
    fractional: float = 0.0
    bound: float = 0.0


def _knapsack(prices: np.ndarray, capacity: int, sizes: np.ndarray) -> tuple[dict[int, int], float]:
    """The dearest filling: dynamic program over capacities (any number of each class)."""
    value = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    s, p = sizes[order], prices[order]
    up_to = np.searchsorted(s, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        k = up_to[c]
        value[c] = value[c - 1]
        if k:
            total = value[c - s[:k]] + p[:k]
            b = int(total.argmax())
            if total[b] > value[c]:
                value[c], choice[c] = total[b], b
    filling: dict[int, int] = defaultdict(int)
    c = capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
            continue
        filling[int(s[choice[c]])] += 1
        c -= int(s[choice[c]])
    return dict(filling), float(value[capacity])


@dataclass
class Cover:
    """configurations with their fractional uses, their sum, and the best dual bound."""

    configurations: list[tuple[dict[int, int], float]]
    containers: float
    bound: float

    @property
    def gap(self) -> float:
        return self.containers / self.bound - 1 if self.bound else 0.0


def solve_configurations(demand: dict[int, int], capacity: int, step: float = 0.25, rate: float = 6.0) -> Cover:
    """A fractional cover of the whole demand by configurations, with a bound.

    The weight of a class falls exponentially (``rate``) with the share of its demand that is covered;
    weight times size is its price, and prices start at the dual solution of a perfect packing.  Each
    round takes the dearest filling until the first of its classes gains ``step`` of its demand or is
    covered; covered classes leave.  Rounds end when nothing is left: each adds ``step`` to a class or
    covers one, so there are at most (1 / step + 1) times the classes.  While all classes are in
    play, demand times price over the filling's price bounds the containers from below (duality).
    """
    sizes = np.array(sorted(demand))
    need = np.array([demand[s] for s in sizes], float)
    at = {int(s): i for i, s in enumerate(sizes)}
    covered = np.zeros(len(sizes))
    use: dict[tuple, float] = defaultdict(float)
    bound = 0.0
    while (live := np.flatnonzero(covered < 1)).size:
        prices = np.exp(-rate * covered) * sizes
        filling, value = _knapsack(prices[live], capacity, sizes[live])
        if live.size == len(sizes):
            bound = max(bound, float(prices @ need) / value)
        often = min(min(step, 1 - covered[at[s]]) * need[at[s]] / n for s, n in filling.items())
        use[tuple(sorted(filling.items()))] += often
        for s, n in filling.items():
            covered[at[s]] += n * often / need[at[s]]
        covered[covered > 1 - 1e-9] = 1.0
    return Cover([(dict(c), x) for c, x in use.items()], sum(use.values()), bound)


def round_cover(cover: Cover, demand: dict[int, int], capacity: int, way: str) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Whole uses of the configurations within the demand, and what they leave.

    way: ``full`` takes the whole part of the uses that fill the container, ``whole`` of all, and
    ``carried`` also adds up the fractions and takes a configuration, as far as its items are still
    there, whenever they make a container.
    """
    left = dict(demand)
    taken: list[tuple[dict[int, int], int]] = []
    carry = 0.0

    def take(filling: dict[int, int], k: int) -> None:
        if filling and k > 0:
            taken.append((filling, k))
            for s, n in filling.items():
                left[s] -= n * k

    for filling, x in sorted(cover.configurations, key=lambda c: (-c[1], sorted(c[0].items()))):
        if way == "full" and sum(s * n for s, n in filling.items()) < capacity:
            continue
        k = min([int(x + 1e-9), *(left[s] // n for s, n in filling.items())])
        take(filling, k)
        carry += x - k
        while way == "carried" and carry >= 1 - 1e-9:
            carry -= 1
            take({s: min(n, left[s]) for s, n in filling.items() if left[s]}, 1)
    return taken, {s: n for s, n in left.items() if n > 0}


def best_fit(left: dict[int, int], capacity: int, begun: list[tuple[dict[int, int], int]] | None = None) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing with multiplicities, into the free room of the ``begun`` containers too:
    equal containers are handled together."""
    open_: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)  # by room left
    for filling, k in begun or []:
        open_[capacity - sum(s * n for s, n in filling.items())].append((filling, k))
    for s in sorted(left, reverse=True):
        n = left[s]
        while n:
            fits = [r for r, g in open_.items() if g and r >= s]
            room = min(fits) if fits else None
            if room is None:
                per = min(capacity // s, n)
                k = n // per
                open_[capacity - per * s].append(({s: per}, k))
                n -= per * k
                continue
            filling, k = open_[room].pop()
            per = min(room // s, n)
            m = min(k, n // per)
            if m < k:
                open_[room].append((filling, k - m))
            grown = dict(filling)
            grown[s] = grown.get(s, 0) + per
            open_[room - per * s].append((grown, m))
            n -= per * m
    return [g for groups in open_.values() for g in groups]


def plan(demand: dict[int, int], capacity: int) -> Plan:
    """Configurations that hold exactly the demand (classes are sizes in units of the grid).

    Of the ways to round the cover the one with the fewest containers is taken; they are no more
    than best-fit alone needs, which is the rounding to nothing.
    """
    if not demand:
        return Plan([], 0)
    cover = solve_configurations(demand, capacity)
    packings = []
    for way in ("full", "carried", "whole"):
        taken, left = round_cover(cover, demand, capacity, way)
        packings.append(best_fit(left, capacity, taken))
    packings.append(best_fit(demand, capacity))
    merged: dict[tuple, int] = defaultdict(int)
    for filling, k in min(packings, key=lambda p: sum(k for _, k in p)):
        merged[tuple(sorted(filling.items()))] += k
    out, first = [], 0
    for filling, k in merged.items():
        out.append((dict(filling), k, first))
        first += k
    return Plan(out, first, cover.containers, cover.bound)


def slots(p: Plan) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each class, the first ranks of its runs of slots and the containers they begin with:
    the r-th document of a run lies in the container r behind the first."""
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    for filling, k, first in p.configurations:
        for s, n in filling.items():
            for _ in range(n):
                runs[s].append((used[s], first))
                used[s] += k
    return {s: (np.array([a for a, _ in r]), np.array([b for _, b in r])) for s, r in runs.items()}


def pack(sizes: DataFrame, key: str = "doc_id", capacity: int = 2048, classes: int = 512, split_ways: int = 64) -> DataFrame:
    """``key, piece, pieces, tokens, token_start, container`` of every document.

    sizes: key (unique), tokens.  A document above the capacity is cut into full containers and a
    rest that is packed like any document; others are never cut.  A document without tokens takes no
    room and gets container null.  Sizes are rounded up to the grid of ``classes`` classes only for
    the program, so no container ever holds more than its capacity.
    """
    spark = sizes.sparkSession
    grid = max(1, -(-capacity // classes))
    units = capacity // grid
    n_pieces = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(capacity)).cast("int"))
    cut = sizes.where(F.col("tokens").isNotNull()).select(key, "tokens", n_pieces.alias("pieces")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    start = F.col("piece").cast("long") * capacity
    cut = cut.select(key, "piece", "pieces", F.least(F.lit(capacity).cast("long"), F.col("tokens") - start).alias("tokens"), start.alias("token_start"))
    # a full piece takes the whole container, whatever the grid leaves over
    size_class = F.when(F.col("tokens") > units * grid, F.lit(units)).otherwise(F.ceil(F.col("tokens") / F.lit(grid))).cast("int")
    part = F.pmod(F.xxhash64(key, "piece"), F.lit(split_ways)).cast("int")
    cut = materialise(cut.withColumn("class", size_class).withColumn("part", part), "pieces")
    counted = cut.where("class > 0").groupBy("class", "part").agg(F.count("*").alias("n"))
    counted = counted.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counted = materialise(counted, "histogram")
    demand = {r["class"]: r["n"] for r in counted.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # at most `classes` rows
    found = slots(plan(demand, units))
    shared = spark.sparkContext.broadcast(found)

    @F.pandas_udf("long")
    def container(cls, rank):
        import pandas as pd

        out = np.full(len(cls), -1, np.int64)
        c, r = cls.to_numpy(), rank.to_numpy()
        for k in np.unique(c):
            pick = c == k
            first, base = shared.value[int(k)]
            i = np.searchsorted(first, r[pick], side="right") - 1
            out[pick] = base[i] + r[pick] - first[i]
        return pd.Series(out)

    # a class may hold a third of all documents: ranks are counted in its parts and shifted
    within = F.row_number().over(Window.partitionBy("class", "part").orderBy(key, "piece")) - 1
    ranked = cut.where("class > 0").withColumn("within", within).join(F.broadcast(counted.select("class", "part", "before")), ["class", "part"])
    placed = ranked.select(key, "piece", "pieces", "tokens", "token_start", container(F.col("class"), (F.col("before") + F.col("within")).cast("long")).alias("container"))
    empty = cut.where("class = 0").select(key, "piece", "pieces", "tokens", "token_start", F.lit(None).cast("long").alias("container"))
    return placed.unionByName(empty)
