"""Checks of small configuration documents on the driver; each returns the list of what is wrong."""

from __future__ import annotations

import math
import re
import tomllib

from pyspark.sql import Column
from pyspark.sql import functions as F


def read_config(path: str, keys: set[str]) -> dict:
    """A TOML document with exactly the given top-level keys."""
    with open(path, "rb") as f:
        doc = tomllib.load(f)
    if set(doc) != keys:
        raise ValueError(f"missing {sorted(keys - set(doc))}, unknown {sorted(set(doc) - keys)}")
    return doc


def chunker_problems(config: dict) -> list[str]:
    out = []
    if not isinstance(config.get("target_tokens"), int) or config["target_tokens"] < 1:
        out.append("target_tokens")
    ratio = config.get("overlap_ratio")
    if not isinstance(ratio, (int, float)) or not 0 <= ratio < 1:
        out.append("overlap_ratio")
    if not str(config.get("chunking_version") or "").strip():
        out.append("chunking_version")
    return out


def chunker_rules(overlap_below: float = 1.0) -> dict[str, Column]:
    """The same checks on rows of configurations."""
    return {
        "target_tokens": F.coalesce(F.col("target_tokens") >= 1, F.lit(False)),
        "overlap_ratio": F.coalesce((F.col("overlap_ratio") >= 0) & (F.col("overlap_ratio") < overlap_below), F.lit(False)),
        "chunking_version": F.coalesce(F.length(F.trim("chunking_version")) > 0, F.lit(False)),
    }


def cleanup_rule_problems(rules: list[dict]) -> list[str]:
    """Unknown kinds and bands, patterns that don't compile or are escaped twice."""
    out = []
    for i, r in enumerate(rules):
        if r.get("kind") not in ("prefix", "equals", "regex"):
            out.append(f"{i}: kind")
        if r.get("band", "any") not in ("top", "bottom", "any"):
            out.append(f"{i}: band")
        if r.get("kind") == "regex":
            try:
                re.compile(r.get("value", ""))
            except re.error:
                out.append(f"{i}: pattern")
            if re.search(r"\\\\[dswb]", r.get("value", "")):
                out.append(f"{i}: escaped twice")
    return out


def weight_problems(weights: dict[str, float]) -> list[str]:
    return [k for k, v in weights.items() if not isinstance(v, (int, float)) or isinstance(v, bool) or not math.isfinite(v) or v < 0]


def bad_weights(weights: Column) -> Column:
    """Names of a map's weights that aren't finite numbers of at least 0."""
    good = lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf"))
    return F.map_keys(F.map_filter(weights, lambda k, v: ~good(v)))


def parse_smoothing(value: str) -> float | None:
    """``standard`` has no floor (None); ``epsilon`` is 0.25 and ``epsilon:x`` is x."""
    if value == "standard":
        return None
    m = re.fullmatch(r"epsilon(?::([0-9]*\.?[0-9]+))?", value)
    if not m:
        raise ValueError(f"unknown smoothing {value!r}")
    return float(m[1]) if m[1] else 0.25


def smoothing_floor(value: Column) -> Column:
    """``parse_smoothing`` of a column; a value that isn't known is null, as ``standard`` is."""
    return F.when(value == "epsilon", 0.25).otherwise(F.nullif(F.regexp_extract(value, r"^epsilon:([0-9]*\.?[0-9]+)$", 1), F.lit("")).cast("double"))


def clamped(limit: Column, most: int) -> Column:
    """A limit of at least 1, at most ``most``; others are null."""
    return F.when(limit >= 1, F.least(limit, F.lit(most)))


def derived_collection(base: Column, strategy: Column) -> Column:
    """``collection_name`` of columns: null for bases with a suffix and unknown strategies."""
    suffix = F.when(strategy == "bag_of_words", "_bow").when(strategy == "bm25_like", "_bm25")
    return F.when(~base.endswith("_bow") & ~base.endswith("_bm25"), F.concat(base, suffix))


def clamp(limit: int, most: int) -> int:
    if limit < 1:
        raise ValueError("a limit is at least 1")
    return min(limit, most)


def collection_name(base: str, strategy: str) -> str:
    suffix = {"bag_of_words": "_bow", "bm25_like": "_bm25"}[strategy]
    if base.endswith(("_bow", "_bm25")):
        raise ValueError("the base name has a suffix already")
    return base + suffix


def artifact_problems(artifact: dict, expected: dict) -> list[str]:
    """Fields in which a stored artifact differs from what the run expects."""
    return [k for k, v in expected.items() if artifact.get(k) != v]
