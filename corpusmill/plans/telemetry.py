"""Telemetry over the events table: counters, fixed-bucket histograms, windows, rates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from .registry import Registry, table

REGISTRY = Registry()
Q = REGISTRY.query
# Upper bounds of the histogram's buckets.
BOUNDS = [1.0, 2.0, 5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 150.0, 200.0, 300.0, 500.0]


def bucket(value):
    """Number of the bucket of a value: how many bounds lie below it."""
    return sum(((value > b).cast("int") for b in BOUNDS[1:]), (value > BOUNDS[0]).cast("int"))


BUCKET_SQL = " + ".join(f"(value > {b})::int" for b in BOUNDS)


@Q("stm09_counters", "select event_type, count(*) as n from events group by 1")
def stm09(spark, folder):
    return table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@Q("stm10_histogram", f"with b as (select event_type, ({BUCKET_SQL})::int as bucket, count(*) as n from events group by 1, 2) select event_type, bucket, n, sum(n) over (partition by event_type order by bucket)::bigint as cumulative from b")
def stm10(spark, folder):
    n = table(spark, folder, "events").groupBy("event_type", bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return n.withColumn("cumulative", F.sum("n").over(w))


@Q("stm11_histogram_quantile")
def stm11(spark, folder):
    b = bucket(F.col("value"))
    counts = table(spark, folder, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(*[F.count_if(b == i).alias(f"c{i}") for i in range(len(BOUNDS) + 1)])
    cols = [F.col(f"c{i}") for i in range(len(BOUNDS) + 1)]
    return counts.select(F.col("w.start").alias("start"), "event_type", *[F.round(M.histogram_quantile(BOUNDS, cols, q), 6).alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.99)])


@Q("stm11_rate_by_window", "select epoch_us(time_bucket(interval 1 hour, ts)) as start_us, event_type, count(*) as n, round(count(*) / 3600.0, 6) as rate from events group by 1, 2")
def stm11r(spark, folder):
    g = table(spark, folder, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.unix_micros(F.col("w.start").cast("timestamp")).alias("start_us"), "event_type", "n", F.round(F.col("n") / 3600.0, 6).alias("rate"))


@Q("stm12_ratio_of_sums", "select event_type, round(sum(value) / greatest(count(*), 1), 6) as mean from events group by 1")
def stm12(spark, folder):
    return table(spark, folder, "events").groupBy("event_type").agg(F.round(F.sum("value") / F.greatest(F.count("*"), F.lit(1)), 6).alias("mean"))


@Q("stm13_sum_by_dependency", "select user_id % 7 as dependency, count(*) as calls, count(*) filter (value > 100) as slow from events group by 1")
def stm13(spark, folder):
    return table(spark, folder, "events").groupBy((F.col("user_id") % 7).alias("dependency")).agg(F.count("*").alias("calls"), F.count_if(F.col("value") > 100).alias("slow"))


@Q("stm14_time_filter", "select event_id, event_type from events where ts between (select min(ts) + interval 2 hour from events) and (select min(ts) + interval 30 hour from events)")
def stm14(spark, folder):
    e = table(spark, folder, "events")
    lo = e.agg((F.min("ts") + F.expr("interval 2 hours")).alias("a"), (F.min("ts") + F.expr("interval 30 hours")).alias("b"))
    return e.join(F.broadcast(lo), F.col("ts").between(F.col("a"), F.col("b"))).select("event_id", "event_type")


@Q("src17_attribute_lookup", "select event_id, user_id from events where event_type = (select min(event_type) from events)")
def src17(spark, folder):
    e = table(spark, folder, "events")
    first = e.agg(F.min("event_type").alias("event_type"))
    return e.join(F.broadcast(first), "event_type").select("event_id", "user_id")
