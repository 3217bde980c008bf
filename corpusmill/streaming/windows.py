"""Windowed telemetry over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schemas.EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, width: str = "120 seconds", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events, sum and rate by window and type; rows later than ``late`` are dropped by the
    watermark.  Works on batches too."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    seconds = (F.col("w.end").cast("timestamp").cast("long") - F.col("w.start").cast("timestamp").cast("long")).cast("double")
    grouped = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total", (F.col("n") / seconds).alias("rate"))


def windowed_histogram(events: DataFrame, bounds: list[float], width: str = "120 seconds", late: str = "10 minutes") -> DataFrame:
    """Counts of fixed buckets by window and type, one column a bucket."""
    b = sum(((F.col("value") > x).cast("int") for x in bounds[1:]), (F.col("value") > bounds[0]).cast("int"))
    counts = [F.count_if(b == i).alias(f"c{i}") for i in range(len(bounds) + 1)]
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(*counts)
