"""Positions in a total order without sorting all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def global_row_number(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add ``name``, the row's position from 0 in ascending ``order`` (nulls first, ties arbitrary).

    The rows are partitioned by ranges of the order and numbered within their partition; a table
    with one row a partition says how many come before.
    """
    parts = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id())
    parts = materialise(parts, "ranges")
    counts = parts.groupBy("_part").agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("low"))
    before = counts.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("_part").orderBy(*order)
    rows = parts.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, F.col("_before") + F.row_number().over(within) - 1)
    return rows.drop("_part", "_before")
