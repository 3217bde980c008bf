"""Occurrences and record counts of every term, maintained by signed deltas.

State is a folder: term tables partitioned by a bucket of the term, and a manifest for each version
that says which buckets are where, so that any session can open it again.  A batch of added, changed
and deleted records becomes signed per-term counts (the old text with minus, the new text with plus);
only the buckets it touches are merged and rewritten.  Deltas are additive: they may come in any
order, a minus may come before its plus, and a term leaves the table when its sums are zero.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_KEYS, materialise, shared_folder

DELTA_SCHEMA = "term string, occurrences long, documents long"
_WORD = re.compile(r"[^\W_]{2,}")
#: Terms a task holds before it hands on its partial counts.
HELD_TERMS = 400_000


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    occurrences: dict[int, Counter] = {1: Counter(), -1: Counter()}
    documents: dict[int, Counter] = {1: Counter(), -1: Counter()}

    def hand_on() -> pa.RecordBatch:
        total, docs = occurrences[1], documents[1]
        total.subtract(occurrences[-1])
        docs.subtract(documents[-1])
        terms = list(total)
        out = pa.record_batch([pa.array(terms, pa.string()), pa.array([total[t] for t in terms], pa.int64()), pa.array([docs[t] for t in terms], pa.int64())], names=["term", "occurrences", "documents"])
        for c in (*occurrences.values(), *documents.values()):
            c.clear()
        return out

    for batch in batches:
        for sign, text in zip(batch["sign"].to_pylist(), batch["text"].to_pylist()):
            found = _WORD.findall(text.lower())
            occurrences[sign].update(found)
            documents[sign].update(set(found))
        if len(occurrences[1]) + len(occurrences[-1]) > HELD_TERMS:
            yield hand_on()
    yield hand_on()


def signed_counts(records: DataFrame) -> DataFrame:
    """Per term the signed occurrences and record counts of ``sign`` (1 or -1), ``text``.

    A term is a word of at least two letters or digits, in lower case.  Tasks combine their rows
    before the shuffle; null texts count nothing.
    """
    counted = records.where(F.col("text").isNotNull()).select("sign", "text").mapInArrow(_count, DELTA_SCHEMA)
    summed = counted.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))
    return summed.where("occurrences <> 0 or documents <> 0")


def delta_records(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """Records with sign of an update: added and changed ones with plus, changed and deleted ones
    with minus; an unchanged record gives none.  Keys must be unique on each side."""
    a = old.select(F.col(key).alias("k"), F.col(text).alias("old_text"))
    b = new.select(F.col(key).alias("k"), F.col(text).alias("new_text"))
    both = a.join(b, "k", "full").where(~F.col("old_text").eqNullSafe(F.col("new_text")))
    return both.select(F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("old_text").alias("text")), F.struct(F.lit(1).alias("sign"), F.col("new_text").alias("text")))).alias("r")).select("r.*").where("text is not null")


class TermCounts:
    """The persistent counts at ``path`` (a new folder of the shared folder by default).

    A path that holds a manifest is opened at its last version.  The number of buckets doubles while a
    bucket has more than ``terms_per_bucket`` terms on the average, so that no task's share grows with
    the collection.  One writer at a time; readers keep the version that they have opened.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, terms_per_bucket: int = 1_000_000, least_buckets: int = 8):
        self.spark, self.terms_per_bucket = spark, terms_per_bucket
        self.path = (path or f"{shared_folder(spark)}/corpusmill/terms-{uuid.uuid4().hex}").rstrip("/")
        self.version, self.buckets = 0, least_buckets
        self.where: dict[int, str] = {}
        versions = [int(m.group(1)) for m in map(re.compile(r"manifest-(\d+)\.json$").search, self._list(self.path)) if m]
        if versions:
            held = json.loads(self.spark.read.text(f"{self.path}/manifest-{max(versions)}.json", wholetext=True).first()[0])
            self.version, self.buckets = held["version"], held["buckets"]
            self.where = {int(b): p for b, p in held["where"].items()}

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, path: str) -> list[str]:
        where, fs = self._fs(path)
        return [str(s.getPath().toString()) for s in fs.listStatus(where)] if fs.exists(where) else []

    def _commit(self) -> None:
        """Write the manifest beside its place and rename it: a version is there whole or not at all."""
        text = json.dumps({"version": self.version, "buckets": self.buckets, "where": self.where})
        part, fs = self._fs(f"{self.path}/.manifest-{self.version}")
        out = fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.rename(part, self._fs(f"{self.path}/manifest-{self.version}.json")[0]):
            raise RuntimeError(f"version {self.version} of {self.path} exists: another writer?")

    def _held(self, buckets: Iterable[int]) -> DataFrame | None:
        live = [f"{self.where[b]}/bucket={b}" for b in buckets if b in self.where]
        return self.spark.read.schema(DELTA_SCHEMA).parquet(*live) if live else None

    def read(self) -> DataFrame | None:
        """``term, occurrences, documents`` of the terms that some record has; None before the first
        delta.  Sums below zero (a minus whose plus is still to come) are held, not shown."""
        held = self._held(sorted(self.where))
        if held is None:
            return self.spark.createDataFrame([], DELTA_SCHEMA) if self.version else None
        return held.where("documents > 0")

    def apply(self, delta: DataFrame) -> "TermCounts":
        """Merge a signed delta; writes only the buckets that it touches, to a new version."""
        delta = materialise(delta.select("term", "occurrences", "documents"), "delta")
        terms = delta.count() + sum(r.count() for r in [self._held(sorted(self.where))] if r is not None)  # from the files' footers
        grown = self.buckets
        while terms > grown * self.terms_per_bucket:
            grown *= 2
        bucket = F.pmod(F.xxhash64("term"), F.lit(grown)).cast("int")
        if grown != self.buckets:  # all buckets are divided
            touched, held = range(grown), self._held(sorted(self.where))
        else:
            touched = [r["bucket"] for r in delta.select(bucket.alias("bucket")).distinct().collect()]  # at most `buckets` rows
            held = self._held(touched)
        merged = delta if held is None else delta.unionByName(held)
        merged = merged.withColumn("bucket", bucket).repartition(grown, "bucket").groupBy("bucket", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents")).where("occurrences <> 0 or documents <> 0")
        out = f"{self.path}/v{self.version + 1}-{uuid.uuid4().hex}"
        merged.write.partitionBy("bucket").parquet(out)
        written = {int(m.group(1)) for m in map(re.compile(r"bucket=(\d+)$").search, self._list(out)) if m}
        where = {} if grown != self.buckets else {b: p for b, p in self.where.items() if b not in set(touched)}
        self.where = where | {b: out for b in touched if b in written}
        self.version, self.buckets = self.version + 1, grown
        self._commit()
        return self

    def vacuum(self) -> None:
        """Delete the tables and manifests that the present version doesn't need."""
        needed = {p.rsplit("/", 1)[1] for p in self.where.values()} | {f"manifest-{self.version}.json"}
        for path in self._list(self.path):
            if path.rsplit("/", 1)[1] not in needed:
                where, fs = self._fs(path)
                fs.delete(where, True)


def surplus_deliveries(df: DataFrame, key: str, text: str, stamp) -> DataFrame:
    """Texts of deliveries that a later one of the same key replaces (ties: the larger text hash).

    Only the keys that occur more than once are looked up; they are broadcast after a count, or
    joined by shuffle beyond BROADCAST_KEYS.
    """
    repeated = materialise(df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).where("n > 1").select("k"), "repeated")
    few = repeated.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("text"), stamp.alias("stamp")).join(F.broadcast(repeated) if few else repeated.hint("merge"), "k", "left_semi")
    order = Window.partitionBy("k").orderBy(F.desc_nulls_last("stamp"), F.desc(F.xxhash64("text")))
    return rows.withColumn("turn", F.row_number().over(order)).where("turn > 1").select("text")


def marked(counts: DataFrame, documents: int | DataFrame, rare_below: int = 3, common_above: float = 0.3) -> DataFrame:
    """Terms with their mark: too_rare in fewer records than rare_below, too_common in more than
    that share of all records, else null; rare comes before common."""
    n = documents if isinstance(documents, DataFrame) else counts.sparkSession.range(1).select(F.lit(documents).cast("long").alias("n"))
    mark = F.when(F.col("documents") < rare_below, F.lit("too_rare")).when(F.col("documents") > common_above * F.col("n"), F.lit("too_common"))
    return counts.crossJoin(F.broadcast(n)).withColumn("mark", mark).drop("n")
