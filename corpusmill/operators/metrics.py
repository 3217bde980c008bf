"""Ranking metrics, weighted means and percentiles.

All metrics are computed in double precision.  A list without relevant items has recall, reciprocal
rank and gain 0; null ranks and ids take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_unique(ranked: DataFrame, group: str, item: str, rank: str, k: int) -> DataFrame:
    """The first k different items of each list, ranked anew from 1 (repeats are dropped before the
    cut).  Ties of rank go by item."""
    best = ranked.where(F.col(rank).isNotNull() & F.col(item).isNotNull()).groupBy(group, item).agg(F.min(rank).alias("_r"))
    order = Window.partitionBy(group).orderBy("_r", item)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_r")


def gain(grade: Column, rank: Column) -> Column:
    return grade / F.log2(rank + F.lit(1.0))


def ideal_gain(graded: DataFrame, group: str, grade: str, item: str, k: int) -> DataFrame:
    """Gain of the best order of all graded items (grade descending, item ascending) cut at k."""
    order = Window.partitionBy(group).orderBy(F.desc(grade), item)
    cut = graded.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    return cut.groupBy(group).agg(F.sum(gain(F.col(grade), F.col("_r"))).alias("ideal"))


def ranking_metrics(ranked: DataFrame, graded: DataFrame, k: int, group: str = "query_id", item: str = "item_id") -> DataFrame:
    """Per list: recall, reciprocal rank, first relevant rank, number of relevant items (soft and
    strict) and normalised gain at k.

    ranked: group, item, rank.  graded: group, item, grade, is_soft, is_strict; the recall's
    denominator is the whole set, not its first k.  Lists of graded without ranked items count 0.
    """
    top = first_unique(ranked, group, item, "rank", k)
    sizes = graded.groupBy(group).agg(F.count_if("is_soft").alias("n_soft"), F.count_if("is_strict").alias("n_strict"))
    hit = top.join(graded, [group, item])
    seen = hit.groupBy(group).agg(
        F.count_if("is_soft").alias("h_soft"), F.count_if("is_strict").alias("h_strict"),
        F.min(F.when(F.col("is_soft"), F.col("rank"))).alias("first_soft"), F.min(F.when(F.col("is_strict"), F.col("rank"))).alias("first_strict"),
        F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"),
    )
    rows = sizes.join(seen, group, "left").join(ideal_gain(graded, group, "grade", item, k), group, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select(
        group,
        *[F.when(F.col(f"n_{s}") > 0, zero(f"h_{s}") / F.col(f"n_{s}")).otherwise(F.lit(0.0)).alias(f"recall_{s}") for s in ("soft", "strict")],
        *[F.coalesce(1.0 / F.col(f"first_{s}"), F.lit(0.0)).alias(f"rr_{s}") for s in ("soft", "strict")],
        *[F.col(f"first_{s}").alias(f"first_rank_{s}") for s in ("soft", "strict")],
        *[zero(f"h_{s}").alias(f"num_relevant_{s}") for s in ("soft", "strict")],
        F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(F.lit(0.0)).alias("ndcg"),
    )


def rank_weighted_mean(score: Column, rank: Column) -> Column:
    """Mean with weight 1/rank over the scores that are not null; null if there is none."""
    known = score.isNotNull()
    return F.sum(F.when(known, score / rank)) / F.sum(F.when(known, 1.0 / rank))


def rank_weighted_mean_all(score: Column, rank: Column) -> Column:
    """The variant whose denominator also holds the rows without a score."""
    return F.sum(score / rank) / F.sum(1.0 / rank)


def reranked_weighted_mean(scored: DataFrame, group: str, score: str, rank: str) -> DataFrame:
    """The variant that ranks anew after dropping the rows without a score."""
    order = Window.partitionBy(group).orderBy(rank)
    known = scored.where(F.col(score).isNotNull()).withColumn("_r", F.row_number().over(order))
    return known.groupBy(group).agg((F.sum(F.col(score) / F.col("_r")) / F.sum(1.0 / F.col("_r"))).alias("weighted"))


def nearest_rank(column: str, p: float) -> Column:
    """The value at position ceil(p * n) of the sorted values."""
    return F.expr(f"cast(percentile_disc({p}) within group (order by {column}) as double)")


def ratio(n: Column, d: Column) -> Column:
    """n / d, and 0 where d is 0."""
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def histogram_quantile(bounds: list[float], counts: list[Column], q: float) -> Column:
    """Quantile of a fixed-bucket histogram by linear interpolation in the bucket; ``counts`` has one
    more entry than bounds (the overflow), which gives the last bound.  Null when all are empty."""
    total = sum(counts[1:], counts[0])
    want = F.lit(q) * total
    out = F.lit(float(bounds[-1]))
    below = [F.lit(0).cast("long")]
    for c in counts[:-1]:
        below.append(below[-1] + c)
    for i in range(len(bounds) - 1, -1, -1):
        low = 0.0 if i == 0 else bounds[i - 1]
        inside = F.lit(low) + F.lit(bounds[i] - low) * (want - below[i]) / counts[i]
        out = F.when((below[i + 1] >= want) & (counts[i] > 0), inside).otherwise(out)
    return F.when(total > 0, out)
