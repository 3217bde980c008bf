"""Violations as rows: each check yields ``key, violations`` (texts), empty where all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks; a rule that is null is broken."""
    return F.array_compact(F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.lit(None).cast("string")).otherwise(F.lit(name)) for name, ok in rules.items()]))


def filled(column: str) -> Column:
    return F.length(F.trim(F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", ""))) > 0


def chunk_rules() -> dict[str, Column]:
    """The contract of a chunk record."""
    return {
        "schema_version": F.col("schema_version") == 1,
        **{c: filled(c) for c in ("doc_id", "chunk_id", "url", "document_title", "chunking_version", "text")},
        "chunk_index": F.col("chunk_index") >= 0,
        "page_start": F.col("page_start") >= 1,
        "page_range": F.col("page_end") >= F.col("page_start"),
        "content_hash": F.col("content_hash").rlike("^sha256:[0-9a-f]{64}$"),
        "section_path": F.col("section_path").isNotNull(),
    }


def capture_rules() -> dict[str, Column]:
    """Row checks of a captured request."""
    return {
        "token_sum": F.col("total_tokens") == F.col("prompt_tokens") + F.col("completion_tokens"),
        "top_k": F.col("top_k_requested") > 0,
        "raw_query": filled("raw_query"),
        "run": filled("runtime_run_id"),
        "reranker_config": F.when(F.col("reranker_kind") == "PassThrough", F.col("reranker_config").isNull()).otherwise(F.col("reranker_config").isNotNull()),
    }


def split_rejects(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that break no rule, and the others with their violations."""
    marked = df.withColumn("violations", violations(rules))
    return marked.where(F.size("violations") == 0).drop("violations"), marked.where(F.size("violations") > 0)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is unknown."""
    return children.join(parents.select(key).distinct(), key, "left_anti")


def same_members(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def permutation(indices: Column, n: Column) -> Column:
    """The array holds 0 to n - 1 once each."""
    return F.array_sort(indices) == F.sequence(F.lit(0), n - 1)


def golden_rules() -> dict[str, Column]:
    """Consistency of a question's relevant sets: soft, strict, graded (with grades 0, .5, 1)."""
    ids = F.transform("graded", lambda g: g["item_id"])
    return {
        "soft_empty": F.size("soft") > 0,
        "strict_not_in_soft": F.size(F.array_except("strict", "soft")) == 0,
        "ungraded": F.size(F.array_except("soft", ids)) == 0,
        "grade": F.forall("graded", lambda g: g["grade"].isin(0.0, 0.5, 1.0)),
    }


def exact_objects(text: Column, fields: dict[str, str]) -> Column:
    """A JSON array whose elements are objects with exactly the given keys, each of its kind.

    Kinds: text (not blank), number, flag.  An empty array holds; null and text that is no JSON array
    don't, nor do elements that aren't objects, have a key too many or too few, or a value of another
    kind (a number stored as text is text).
    """
    kinds = {"text": "STRING", "number": r"(?:TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL\(\d+,\d+\))", "flag": "BOOLEAN"}
    items = F.from_json(text, "array<string>")

    def holds(item: Column) -> Column:
        value = F.try_parse_json(item)
        ok = F.coalesce(F.array_sort(F.json_object_keys(item)) == F.array(*[F.lit(k) for k in sorted(fields)]), F.lit(False))
        for key, kind in fields.items():
            ok = ok & F.coalesce(F.schema_of_variant(F.try_variant_get(value, f"$.{key}", "variant")).rlike(f"^{kinds[kind]}$"), F.lit(False))
            if kind == "text":
                ok = ok & F.coalesce(F.length(F.trim(F.get_json_object(item, f"$.{key}"))) > 0, F.lit(False))
        return ok

    array = F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("ARRAY"), F.lit(False))
    return array & F.coalesce(F.forall(items, holds), F.lit(False))
