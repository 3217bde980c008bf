"""Mixing sources to target shares by pivotal dependent rounding.

A document of a source gets the fraction ``target tokens / source tokens`` of a copy, at most
``max_repeats``.  Its whole part is copied for certain; the fractional parts are rounded in pairs:
tokens are moved at random from one document's probability to the other's until one of them is 0 or
1, so the expected tokens stay what they were and the sum hardly moves.  Every task leaves at most
one undecided document a mix and source; these are rounded against each other in a tree of groups of
bounded size, and the last one by its own probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .wordscan import mix64

UNIT_SCHEMA = "mix_name string, source string, doc_id long, tokens long, whole int, chance double, decided boolean, slot int"
FAN_IN = 64


def source_name(column):
    """A source without outer blanks and letter case."""
    return F.lower(F.trim(F.regexp_replace(column, r"(?U)^\s+|\s+$", "")))


def _uniform(*keys: int) -> float:
    h = np.zeros(1, np.uint64)
    for k in keys:
        h = mix64(h ^ np.array([k], np.int64).astype(np.uint64))
    return float(h[0] >> np.uint64(11)) / float(1 << 53)


def pair_off(a: list, b: list, seed: int) -> tuple[list, list]:
    """Round two units ``[doc, tokens, whole, chance]`` against each other; the first returned is
    decided (chance 0 or 1), the second may be undecided.  chance * tokens keeps its sum."""
    na, nb = max(1, a[1]), max(1, b[1])
    ma, mb = a[3] * na, b[3] * nb
    up = min(na - ma, mb)  # tokens that a can take from b
    down = min(ma, nb - mb)  # tokens that a can give to b
    if up + down <= 0:
        return (a, b) if a[3] in (0.0, 1.0) else (b, a)
    move = up if _uniform(seed, a[0], b[0]) < down / (up + down) else -down
    a, b = [*a[:3], (ma + move) / na], [*b[:3], (mb - move) / nb]
    for u in (a, b):
        if u[3] < 1e-9:
            u[3] = 0.0
        elif u[3] > 1 - 1e-9:
            u[3] = 1.0
    return (a, b) if a[3] in (0.0, 1.0) else (b, a)


def _round(seed: int):
    """Units of one task: all but one a mix and source are decided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slot = TaskContext.get().partitionId()
        waiting: dict[tuple, list] = {}
        names = [f.split()[0] for f in UNIT_SCHEMA.split(", ")]
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.bool_(), pa.int32()]

        def out(rows):
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            rows = []
            for mix, source, doc, tokens, whole, chance in zip(*(batch[c].to_pylist() for c in ("mix_name", "source", "doc_id", "tokens", "whole", "chance"))):
                unit = [doc, tokens, whole, chance]
                if chance <= 0.0:
                    rows.append((mix, source, *unit, True, slot))
                    continue
                other = waiting.pop((mix, source), None)
                if other is not None:
                    done, unit = pair_off(other, unit, seed)
                    rows.append((mix, source, *done, True, slot))
                    if unit[3] in (0.0, 1.0):
                        rows.append((mix, source, *unit, True, slot))
                        continue
                waiting[mix, source] = unit
            if rows:
                yield out(rows)
        if waiting:
            yield out([(*key, *unit, False, slot) for key, unit in waiting.items()])

    return run


def _round_group(seed: int, last: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["slot", "doc_id"], kind="stable")
        rows, wait = [], None
        for r in group.itertuples(index=False):
            unit = [int(r.doc_id), int(r.tokens), int(r.whole), float(r.chance)]
            if wait is None:
                wait = unit
                continue
            done, wait = pair_off(wait, unit, seed)
            rows.append((*done, True))
            if wait[3] in (0.0, 1.0):
                rows.append((*wait, True))
                wait = None
        if wait is not None:
            if last:
                wait[3] = 1.0 if _uniform(seed, wait[0], 7) < wait[3] else 0.0
            rows.append((*wait, last))
        first = group.iloc[0]
        return pd.DataFrame([(first["mix_name"], first["source"], *u, int(first["slot"])) for u in rows], columns=[f.split()[0] for f in UNIT_SCHEMA.split(", ")])

    return run


def mix_plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """A row of targets each, with the source's tokens, the mix's total and whether it is reachable.

    sized: source (cleaned name or null), tokens.  Rows of targets without a mix, source or share
    are left out; a share of 0 needs nothing.  Spellings of a source in a mix are added up.
    """
    per_source = sized.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    per_source = materialise(per_source, "sources")
    total = per_source.agg(F.coalesce(F.sum("source_tokens"), F.lit(0)).alias("total_tokens"))
    t = targets.where("mix_name is not null and source is not null and target_share is not null").withColumn("asked", F.col("source")).withColumn("source", source_name(F.col("source")))
    t = t.groupBy("mix_name", "source").agg(F.min("asked").alias("asked"), F.sum("target_share").alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("max_repeats"))
    rows = t.join(per_source, "source", "left").crossJoin(F.broadcast(total)).withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0)))
    wanted = F.col("target_share") * F.col("total_tokens")
    rows = rows.withColumn("target_tokens", wanted).withColumn("reachable", F.col("source_tokens") * F.col("max_repeats") >= F.col("target_tokens"))
    copies = F.when(F.col("source_tokens") > 0, F.least(F.col("max_repeats").cast("double"), F.col("target_tokens") / F.col("source_tokens"))).otherwise(F.lit(0.0))
    return materialise(rows.withColumn("copies", copies), "mix-plan")


def select_copies(sized: DataFrame, plan: DataFrame, seed: int = 20240229) -> DataFrame:
    """``mix_name, source, doc_id, tokens, copies`` of the documents a mix uses."""
    few = plan.limit(100_001).count() <= 100_000  # rows of the targets, normally a handful
    p = plan.where("copies > 0").select("mix_name", "source", "copies")
    units = sized.where("source is not null").join(F.broadcast(p) if few else p.hint("merge"), "source")
    whole = F.floor(F.col("copies") + 1e-12).cast("int")
    chance = F.greatest(F.lit(0.0), F.col("copies") - whole)
    units = units.select("mix_name", "source", "doc_id", "tokens", whole.alias("whole"), F.when(chance < 1e-9, 0.0).otherwise(chance).alias("chance"))
    level = materialise(units.mapInArrow(_round(seed), UNIT_SCHEMA), "level")
    done = [level.where("decided")]
    open_ = level.where("not decided")
    width = (open_.agg(F.max("slot").alias("m")).first()["m"] or 0) + 1
    while True:
        width = -(-width // FAN_IN)
        last = width <= 1
        grouped = open_.withColumn("slot", F.floor(F.col("slot") / FAN_IN).cast("int")).groupBy("mix_name", "source", "slot")
        level = materialise(grouped.applyInPandas(_round_group(seed, last), UNIT_SCHEMA), "level")
        done.append(level.where("decided"))
        if last:
            break
        open_ = level.where("not decided")
    decided = done[0]
    for d in done[1:]:
        decided = decided.unionByName(d)
    copies = (F.col("whole") + F.col("chance").cast("int")).cast("int")
    return decided.select("mix_name", "source", "doc_id", "tokens", copies.alias("copies")).where("copies > 0")


def mix_report(plan: DataFrame, chosen: DataFrame) -> DataFrame:
    """Target and actual share of every row of the targets; shares are of the mix's own tokens."""
    got = chosen.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("actual_tokens"), F.max("copies").alias("most_copies"), F.count("*").alias("documents"))
    got = materialise(got, "mix-got")
    sums = got.groupBy("mix_name").agg(F.sum("actual_tokens").alias("mix_tokens"))
    rows = plan.join(got, ["mix_name", "source"], "left").join(sums, "mix_name", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = F.when(F.col("mix_tokens") > 0, zero("actual_tokens") / F.col("mix_tokens")).otherwise(F.lit(0.0))
    return rows.select("mix_name", F.col("asked").alias("source"), "target_share", "max_repeats", "source_tokens", "total_tokens", "target_tokens", zero("actual_tokens").alias("actual_tokens"), share.alias("actual_share"), (zero("actual_tokens") / F.greatest(F.col("total_tokens"), F.lit(1))).alias("actual_share_of_total"), zero("most_copies").alias("most_copies"), zero("documents").alias("documents"), "reachable")
