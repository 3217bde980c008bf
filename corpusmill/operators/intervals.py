"""Intervals of whole numbers ``[start, end]`` a group: merge, subtract, overlap, containment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(df: DataFrame, group: str, start: str = "start", end: str = "end", touch: int = 0) -> DataFrame:
    """Maximal intervals of each group: intervals that overlap, or whose gap is below ``touch``,
    become one.  Null bounds and empty intervals (end < start) take no part."""
    rows = df.where(f"{start} is not null and {end} is not null and {end} >= {start}")
    before = Window.partitionBy(group).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_reach", F.max(end).over(before))
    new = (F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + touch)).cast("int")
    upto = Window.partitionBy(group).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_island", F.sum(new).over(upto))
    return rows.groupBy(group, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def subtract(parents: DataFrame, children: DataFrame, group: str) -> DataFrame:
    """What is left of each parent interval when its group's children are taken away.

    One parent a group; columns group, start, end on both sides, ends inclusive.
    """
    merged = merge(children, group, touch=1)
    inside = merged.join(parents.select(group, F.col("start").alias("_a"), F.col("end").alias("_b")), group).where("end >= _a and start <= _b")
    cut = inside.select(group, "_a", "_b", F.greatest("start", "_a").alias("start"), F.least("end", "_b").alias("end"))
    order = Window.partitionBy(group).orderBy("start")
    cut = cut.withColumn("_next", F.lead("start").over(order)).withColumn("_first", F.row_number().over(order) == 1)
    gaps = cut.select(group, F.explode(F.array_compact(F.array(
        F.when(F.col("_first") & (F.col("start") > F.col("_a")), F.struct(F.col("_a").alias("start"), (F.col("start") - 1).alias("end"))),
        F.when(F.coalesce("_next", F.col("_b") + 1) > F.col("end") + 1, F.struct((F.col("end") + 1).alias("start"), (F.coalesce("_next", F.col("_b") + 1) - 1).alias("end"))),
    ))).alias("_gap")).select(group, "_gap.*")
    untouched = parents.join(inside.select(group).distinct(), group, "left_anti").select(group, "start", "end")
    return gaps.unionByName(untouched)


def containing(points: DataFrame, ranges: DataFrame, group: str, point: str, step: int = 64) -> DataFrame:
    """Pairs of a point and the ranges of its group that contain it.

    Ranges are spread over the cells of ``step`` width that they touch, so the join is an equality
    on (group, cell) and never compares every point with every range.
    """
    cells = ranges.where("start is not null and end is not null and end >= start").withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start") / step), F.floor(F.col("end") / step))))
    located = points.withColumn("_cell", F.floor(F.col(point) / step))
    return located.join(cells, [group, "_cell"]).where(F.col(point).between(F.col("start"), F.col("end"))).drop("_cell")


def overlapping(a: DataFrame, b: DataFrame, group: str, step: int = 64) -> DataFrame:
    """Pairs (a_id, b_id) of intervals of one group that overlap, by shared cells; a pair that shares
    several cells counts once."""
    cell = lambda d, p: d.where("end >= start").select(group, F.col("id").alias(f"{p}_id"), F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"), F.explode(F.sequence(F.floor(F.col("start") / step), F.floor(F.col("end") / step))).alias("_cell"))
    both = cell(a, "a").join(cell(b, "b"), [group, "_cell"]).where("a_start <= b_end and b_start <= a_end")
    first = F.floor(F.greatest("a_start", "b_start") / step)
    return both.where(F.col("_cell") == first).select(group, "a_id", "b_id")


def coverage(df: DataFrame, group: str) -> DataFrame:
    """Length covered by the merged intervals of each group."""
    return merge(df, group, touch=1).groupBy(group).agg(F.sum(F.col("end") - F.col("start") + 1).alias("covered"))
