"""Readers of JSON lines, JSON documents, text lists, tables and run folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped, a line that doesn't fit has ``_corrupt_record``."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.select(parsed.alias("r")).select("r.*")


def positioned(rows: DataFrame) -> DataFrame:
    """Rows of one file with their ``position`` among its lines, from 0.

    Ids rise with the place in the file; a row's position is counted by partitions.
    """
    from ..operators.ordering import global_row_number

    return global_row_number(rows.withColumn("_at", F.monotonically_increasing_id()), ["_at"], "position").drop("_at")


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable rows, and the lines that weren't."""
    return df.where("_corrupt_record is null").drop("_corrupt_record"), df.where("_corrupt_record is not null").select("_corrupt_record")


def pages(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """Page records in page order.  Strict: rows without a page are left out.  Lenient: such a row
    has its position among the file's lines as page, and its text is collapsed."""
    from ..functions.text import collapse

    rows, _ = split_corrupt(json_lines(spark, path, schemas.PAGE))
    if not lenient:
        return rows.where("page is not null").orderBy("doc_id", "page")
    numbered = rows.withColumn("_at", F.monotonically_increasing_id())
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("_at"))
    return numbered.withColumn("page", F.coalesce("page", place)).withColumn("clean_text", collapse(F.col("clean_text"))).drop("_at").orderBy("doc_id", "page")


def chunk_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Chunks that keep the contract, and rejects ``chunk_id, chunk_index, stage, error``."""
    from ..operators.validate import chunk_rules, split_rejects

    rows, broken = split_corrupt(json_lines(spark, path, schemas.CHUNK))
    good, bad = split_rejects(rows, chunk_rules())
    rejects = bad.select("chunk_id", "chunk_index", F.lit("validate").alias("stage"), F.array_join("violations", ", ").alias("error"))
    unreadable = broken.select(F.lit(None).cast("string").alias("chunk_id"), F.lit(None).cast("bigint").alias("chunk_index"), F.lit("validate").alias("stage"), F.lit("unreadable line").alias("error"))
    return good, rejects.unionByName(unreadable)


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Index by key in which the last of repeated records wins."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def golden_targets(spark: SparkSession, path: str) -> DataFrame:
    """``question, item_id, grade, is_soft, is_strict`` of a golden companion document; ungraded
    items have grade 0."""
    q = spark.read.schema(schemas.GOLDEN).option("multiLine", True).json(path).select(F.explode("questions").alias("q")).select("q.*")
    ids = F.array_distinct(F.flatten(F.array(F.coalesce("soft_positive_chunk_ids", F.array()), F.coalesce("strict_positive_chunk_ids", F.array()), F.transform("graded_relevance", lambda g: g["chunk_id"]))))
    rows = q.select("question", "soft_positive_chunk_ids", "strict_positive_chunk_ids", "graded_relevance", F.explode(ids).alias("item_id"))
    grade = F.get(F.transform(F.filter("graded_relevance", lambda g: g["chunk_id"] == F.col("item_id")), lambda g: g["score"].cast("double")), F.lit(0))
    return rows.select("question", "item_id", F.coalesce(grade, F.lit(0.0)).alias("grade"), F.coalesce(F.array_contains("soft_positive_chunk_ids", F.col("item_id")), F.lit(False)).alias("is_soft"), F.coalesce(F.array_contains("strict_positive_chunk_ids", F.col("item_id")), F.lit(False)).alias("is_strict"))


def questions(spark: SparkSession, path: str) -> DataFrame:
    """One question a line that isn't blank."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("question"))


def question_tags(spark: SparkSession, path: str, catalog: DataFrame) -> DataFrame:
    """``question_id, tag``; raises if a question has no tag, a repeated one, or isn't known."""
    rows = spark.read.schema(schemas.QUESTION_TAGS).option("multiLine", True).json(path)
    problems = rows.where("tags is null or size(tags) = 0 or size(array_distinct(tags)) <> size(tags)").count()
    missing = catalog.select("question_id").join(rows, "question_id", "left_anti").count() + rows.join(catalog.select("question_id"), "question_id", "left_anti").count()
    if problems or missing:
        raise ValueError(f"question tags: {problems} bad rows, {missing} rows without a partner")
    return rows.select("question_id", F.explode("tags").alias("tag"))


def run_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """Manifests of all run folders with their path, newest first; unreadable ones are left out and
    start times that can't be read come last."""
    rows = spark.read.schema(f"{schemas.MANIFEST}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(f"{folder}/*/run_manifest.json")
    rows = rows.withColumn("path", F.col("_metadata.file_path")).where("run_id is not null")
    return rows.drop("_corrupt_record").orderBy(F.desc_nulls_last(F.try_to_timestamp("started_at")))


def jdbc_table(spark: SparkSession, url: str, name: str, partition: str | None = None, bounds: tuple[int, int] = (0, 1), parts: int = 16, **options: str) -> DataFrame:
    """A table of a relational database, read in ``parts`` ranges of a numeric column."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if partition:
        reader = reader.option("partitionColumn", partition).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def scroll(df: DataFrame, must: dict | None = None, limit: int | None = None) -> DataFrame:
    """Points that match all values; a limit only where a sample is asked for."""
    for column, value in (must or {}).items():
        df = df.where(F.col(column).eqNullSafe(F.lit(value)))
    return df if limit is None else df.limit(limit)
