"""Keyed writes on immutable tables: upserts, inserts that ignore conflicts, change classification,
state transitions.  Every function returns the new table; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, and new rows whose key isn't there; of repeated new keys one row is kept."""
    fresh = new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def insert_or_fail(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old and new rows; a new key that is there already, or comes twice, is an error and nothing is
    added.  Null keys equal each other."""
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    known = new.select(*keys).alias("a").join(old.select(*keys).alias("b"), same, "left_semi")
    twice = new.groupBy(*keys).count().where("count > 1").select(*keys)
    first = known.unionByName(twice).first()
    if first is not None:
        raise ValueError(f"duplicate key {first.asDict()}")
    return old.unionByName(new.select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """One row a key: the one with the greatest ``order`` of both tables; new rows win ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order) if isinstance(order, str) else order.desc_nulls_last(), F.desc("_new"))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def fingerprint(columns: list[Column]) -> Column:
    """SHA-256 of the compact JSON array of the values as text."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])), 256)


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID (version 5) of a text inside the JVM."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.lpad(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)), 2, "0"))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12))


def classify_changes(old: DataFrame, new: DataFrame, key: str, print_col: str = "print", meta_col: str = "meta") -> DataFrame:
    """``key, action``: insert (unknown key), skip_and_log (fingerprint changed), update (only the
    metadata changed) or skip.  Keys only the old table has don't appear; null keys are left out."""
    o = old.select(key, F.col(print_col).alias("_p"), F.col(meta_col).alias("_m"), F.lit(True).alias("_known"))
    rows = new.where(F.col(key).isNotNull()).dropDuplicates([key]).join(o, key, "left")
    action = (
        F.when(F.col("_known").isNull(), "insert")
        .when(~F.col(print_col).eqNullSafe(F.col("_p")), "skip_and_log")
        .when(~F.col(meta_col).eqNullSafe(F.col("_m")), "update")
        .otherwise("skip")
    )
    return rows.select(key, action.alias("action"))


def apply_changes(old: DataFrame, new: DataFrame, key: str, print_col: str = "print", meta_col: str = "meta") -> tuple[DataFrame, DataFrame]:
    """The table after an ingest of ``new``, and the actions.

    Unknown keys are added and changed metadata replaced; a record whose fingerprint changed stays as
    it was and is only named in the actions, so that a second ingest of the same rows changes nothing.
    """
    actions = classify_changes(old, new, key, print_col, meta_col)
    fresh = new.join(actions.where("action in ('insert', 'update')").select(key), key, "left_semi").dropDuplicates([key])
    return old.join(fresh.select(key), key, "left_anti").unionByName(fresh.select(*old.columns)), actions


def update_changed(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Old rows with the named columns of their new row; other columns never change."""
    fresh = new.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    rows = old.join(fresh, key, "left")
    return rows.select(*[F.when(F.col("_hit") & ~F.col(c).eqNullSafe(F.col(f"_{c}")), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


STAGES = ["judge_generation", "judge_retrieval", "build_request_summary"]


def bootstrap(captures: DataFrame, state: DataFrame) -> DataFrame:
    """State rows of requests that have none yet: first stage, pending, no attempt."""
    fresh = captures.join(state.select("request_id"), "request_id", "left_anti")
    return fresh.select("request_id", "received_at", F.lit(STAGES[0]).alias("stage"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"))


def transition(state: DataFrame, outcome: DataFrame) -> DataFrame:
    """State after the outcomes ``request_id, ok``: completed or failed, one more attempt."""
    rows = state.join(outcome.select("request_id", "ok").dropDuplicates(["request_id"]), "request_id", "left")
    status = F.when(F.col("ok").isNull(), F.col("status")).when(F.col("ok"), "completed").otherwise("failed")
    return rows.select("request_id", "received_at", "stage", status.alias("status"), (F.col("attempts") + F.col("ok").isNotNull().cast("int")).alias("attempts"))


def promote(state: DataFrame) -> DataFrame:
    """Completed rows of a stage with a successor wait in the next stage."""
    following = F.when(F.col("stage") == STAGES[0], STAGES[1]).when(F.col("stage") == STAGES[1], STAGES[2])
    moves = (F.col("status") == "completed") & following.isNotNull()
    return state.select("request_id", "received_at", F.when(moves, following).otherwise(F.col("stage")).alias("stage"), F.when(moves, F.lit("pending")).otherwise(F.col("status")).alias("status"), "attempts")


def drain(state: DataFrame, stage: str, work, rounds: int = 10) -> DataFrame:
    """Run ``work`` (open rows to outcomes) on a stage until nothing is open.

    Failed rows are tried again; a round without progress, or more than ``rounds``, is an error.
    """
    for _ in range(rounds):
        todo = state.where((F.col("stage") == stage) & (F.col("status") != "completed"))
        left = todo.count()
        if not left:
            return state
        state = transition(state, work(todo))
        if state.where((F.col("stage") == stage) & (F.col("status") != "completed")).count() >= left:
            raise RuntimeError(f"no progress in stage {stage}")
    raise RuntimeError(f"stage {stage} isn't finished after {rounds} rounds")
