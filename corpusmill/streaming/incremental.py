"""Incremental evaluation: micro-batches merged into keyed tables, exactly once per batch."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.upsert import insert_ignore, upsert
from ..session import materialise
from ..sources.writers import write_text


class KeyedTable:
    """A keyed table in a shared folder that micro-batches are merged into.

    Rows lie in buckets of their keys.  A batch rewrites only the buckets it touches; a manifest for
    each batch says which folder holds which bucket, so a batch number that is there already isn't
    applied again and a restarted stream changes nothing twice.  Folders that neither the present nor
    the previous version needs are deleted.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], order: str | None = None, buckets: int = 16):
        self.spark, self.path, self.schema, self.keys, self.order, self.buckets = spark, path.rstrip("/"), schema, keys, order, buckets

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        root, fs = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(m.group(1)) for m in map(re.compile(r"v(\d+)\.json").fullmatch, names) if m)

    def version(self) -> int | None:
        return max(self._versions(), default=None)

    def _manifest(self, version: int | None) -> dict:
        if version is None:
            return {"buckets": self.buckets, "where": {}}
        return json.loads(self.spark.read.text(f"{self.path}/v{version}.json", wholetext=True).first()[0])

    def _rows(self, manifest: dict, buckets: Iterable[str]) -> DataFrame:
        paths = [f"{self.path}/{manifest['where'][b]}/bucket_={b}" for b in buckets if b in manifest["where"]]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        held = self._manifest(self.version())
        return self._rows(held, sorted(held["where"]))

    def apply(self, batch: DataFrame, number: int) -> None:
        """Merge a batch: last writer wins by ``order``, or existing keys stay without one."""
        v = self.version()
        if v is not None and v >= number:
            return
        held = self._manifest(v)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(held["buckets"])).cast("string")
        new = materialise(batch.select(*self.spark.createDataFrame([], self.schema).columns), "batch")
        touched = [r[0] for r in new.select(bucket).distinct().collect()]  # at most `buckets` rows
        old = self._rows(held, touched)
        merged = upsert(old, new, self.keys, self.order) if self.order else insert_ignore(old, new, self.keys)
        folder = f"batch-{number}"
        merged.withColumn("bucket_", bucket).repartition(held["buckets"], "bucket_").write.mode("overwrite").partitionBy("bucket_").parquet(f"{self.path}/{folder}")
        where = held["where"] | {b: folder for b in touched}
        write_text(self.spark, f"{self.path}/v{number}.json", json.dumps({"buckets": held["buckets"], "where": where}))
        self._forget(set(where.values()) | set(held["where"].values()), {number, v})

    def _forget(self, folders: set[str], versions: set[int | None]) -> None:
        root, fs = self._fs()
        for s in fs.listStatus(root):
            name = s.getPath().getName()
            old = re.fullmatch(r"v(\d+)\.json", name)
            if name.startswith("batch-") and name not in folders or old and int(old.group(1)) not in versions:
                fs.delete(s.getPath(), True)


def follow(stream: DataFrame, target: KeyedTable, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda b: b):
    """Run the stream over all that is there now and merge every micro-batch into the table."""
    query = stream.writeStream.foreachBatch(lambda batch, number: target.apply(prepare(batch), number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return target
