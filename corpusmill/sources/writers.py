"""Writers: JSON lines, reject logs, CSV reports, Markdown reports, manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, mode: str = "error") -> None:
    """One object a line, null fields left in; as many files as partitions."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_rejects(df: DataFrame, path: str) -> None:
    df.select("chunk_id", "chunk_index", "stage", "error").write.mode("append").json(path)


def formatted(df: DataFrame, digits: int = 4) -> DataFrame:
    """Numbers with a fraction as text of fixed digits, nulls as n/a, arrays joined by semicolons."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("double", "float") or kind.startswith("decimal"):
            c = F.format_string(f"%.{digits}f", c.cast("double"))
            c = F.when(F.col(name).isNotNull(), c)
        elif kind.startswith("array"):
            c = F.array_join(c, ";")
        out.append(F.coalesce(c.cast("string"), F.lit("n/a")).alias(name))
    return df.select(*out)


def csv_report(df: DataFrame, path: str, digits: int = 4, mode: str = "overwrite") -> None:
    formatted(df, digits).write.mode(mode).option("header", True).csv(path)


def markdown_table(df: DataFrame, most_rows: int = 200, digits: int = 4) -> str:
    """A small result as a Markdown table; more than ``most_rows`` rows are an error, not a cut."""
    rows = formatted(df, digits).limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows: write a table instead")
    head = df.columns
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    return "\n".join(lines + ["| " + " | ".join(x.replace("|", "\\|") for x in r) + " |" for r in rows])


def run_report(title: str, sections: dict[str, DataFrame]) -> str:
    """Sections with results in Markdown; a section without rows is left out."""
    parts = [f"# {title}"]
    for name, df in sections.items():
        if not df.isEmpty():
            parts += [f"## {name}", markdown_table(df)]
    return "\n\n".join(parts) + "\n"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in a folder of the cluster's file system, written beside its place and renamed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    part = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.part")
    fs = target.getFileSystem(conf)
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"{path} can't be written")


def manifest(spark: SparkSession, path: str, record: dict, required: tuple[str, ...] = ("run_id", "status", "started_at")) -> None:
    """A run's manifest; a required field that is missing or empty is an error."""
    missing = [k for k in required if not record.get(k)]
    if missing:
        raise ValueError(f"manifest lacks {missing}")
    write_text(spark, path, json.dumps(record, ensure_ascii=False))


def create_collection(spark: SparkSession, path: str, schema: str, properties: dict) -> bool:
    """A collection is a table folder with its properties beside it.  True if it was created, False if
    it is there with the same properties; other properties are an error."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/collection.json")
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        held = json.loads(spark.read.text(f"{path}/collection.json", wholetext=True).first()[0])
        if held != {"schema": schema, "properties": properties}:
            raise ValueError(f"the collection at {path} has other properties")
        return False
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/points")
    write_text(spark, f"{path}/collection.json", json.dumps({"schema": schema, "properties": properties}))
    return True
