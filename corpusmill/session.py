"""Session helpers: the shared folder for tables that cut lineage, and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which the key side of a semi join is broadcast; beyond it a shuffle join is used.
BROADCAST_KEYS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only where the session names none (tests on one machine) a folder of our own is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + os.path.join(tempfile.gettempdir(), f"corpusmill-{os.getpid()}")
    spark.sparkContext.setCheckpointDir(own)
    return own


#: For tables that take large shuffles: Spark removes the shuffle files of a statement as soon as it has ended, not
#: when the driver collects garbage, and sends Python batches of 4 MB.
LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def materialise(df: DataFrame, name: str, lean: bool = False, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    The table survives the loss of executors and is computed once, whatever reads it.  lean: with the
    settings of LEAN.  codec: the files' compression, for tables of texts.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/corpusmill/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in LEAN} if lean else {}
    try:
        for k in before:
            spark.conf.set(k, LEAN[k])
        df.write.parquet(path, compression=codec)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def semi_join_keys(df: DataFrame, keys: DataFrame, on: str, limit: int = BROADCAST_KEYS, anti: bool = False) -> DataFrame:
    """Rows of ``df`` whose ``on`` is (``anti``: isn't) in the distinct, materialised ``keys``.

    ``keys`` is broadcast only after counting that it has at most ``limit`` rows; a larger one
    goes through a shuffle join.
    """
    few = keys.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(keys) if few else keys.hint("merge"), on, "left_anti" if anti else "left_semi")


def join_few(df: DataFrame, small: DataFrame, on: str | list[str], limit: int = BROADCAST_KEYS, how: str = "inner") -> DataFrame:
    """Join with a materialised side of narrow rows, which is broadcast only after counting that it has at most
    ``limit`` rows; then the rows of ``df``, which may be long texts, stay where they are."""
    return df.join(F.broadcast(small) if small.limit(limit + 1).count() <= limit else small, on, how)


def join_hot(df: DataFrame, small: DataFrame, on: str, limit: int = BROADCAST_KEYS, salts: int = 16) -> DataFrame:
    """Inner join with a materialised side of fewer rows, where one key may have most rows of ``df``.

    ``small`` is broadcast only after counting that it has at most ``limit`` rows; else its rows are
    repeated for each of ``salts`` parts, over which the rows of a key are spread.
    """
    if small.limit(limit + 1).count() <= limit:
        return df.join(F.broadcast(small), on)
    part = F.pmod(F.xxhash64(*[c for c in df.columns]), F.lit(salts)).cast("int")
    spread = small.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("_part", part).join(spread.hint("merge"), [on, "_part"]).drop("_part")


def sweep(spark: SparkSession, name: str | None = None) -> None:
    """Delete the tables that this library wrote to the shared folder (``name``: only those that
    ``materialise`` got this name for); results still to be computed from them can't be read afterwards."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/corpusmill")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if name is None:
        fs.delete(root, True)
    elif fs.exists(root):
        for s in fs.listStatus(root):
            if s.getPath().getName().startswith(f"{name}-"):
                fs.delete(s.getPath(), True)
