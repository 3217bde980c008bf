"""Model calls as batch functions: the caller gives the function, the operator gives batching, retry,
fallback to single items and accounting.  The defaults are deterministic stand-ins for tests."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Retriever(Protocol):
    """Maps queries (query_id, query) to ranked items (query_id, item_id, score, rank)."""

    def __call__(self, queries: DataFrame) -> DataFrame: ...


class Reranker(Protocol):
    """Maps candidates to the same rows with new scores and ranks."""

    def __call__(self, candidates: DataFrame) -> DataFrame: ...


def pass_through(candidates: DataFrame) -> DataFrame:
    return candidates


def with_retry(call: Callable, attempts: int = 3, base_seconds: float = 0.1) -> Callable:
    """Call again after base * 2**i seconds, at most ``attempts`` times; the last error is raised."""

    def run(batch):
        for i in range(attempts):
            try:
                return call(batch)
            except Exception:
                if i == attempts - 1:
                    raise
                time.sleep(base_seconds * 2**i)

    return run


def hash_embedding(texts: list[str], dimension: int = 8) -> list[list[float]]:
    """A deterministic stand-in for an embedding model: values in [0, 1) from SHA-256."""
    out = []
    for t in texts:
        h = hashlib.sha256(t.encode()).digest()
        out.append([h[i % 32] / 256.0 for i in range(dimension)])
    return out


def overlap_judge(pairs: list[tuple[str, str]]) -> list[float]:
    """A stand-in for a scorer: the share of the first text's words that the second has."""
    out = []
    for a, b in pairs:
        x, y = set(a.lower().split()), set(b.lower().split())
        out.append(len(x & y) / len(x) if x else 0.0)
    return out


def embed(df: DataFrame, key: str, text: str, model: Callable[[list[str]], list[list[float]]] = hash_embedding, dimension: int = 8, batch_size: int = 64, attempts: int = 1) -> DataFrame:
    """``key, embedding, error``: batches of texts through the model.

    A batch that fails or has a wrong count is tried item by item, so one bad text costs only its own
    row, which gets an error instead of a vector.  Null texts are errors; a vector of another
    dimension is one too.
    """
    kind = dict(df.dtypes)[key]
    call = with_retry(model, attempts, 0.01)

    def one(t):
        try:
            v = call([t])[0]
            return (None, f"dimension {len(v)}") if len(v) != dimension else (v, None)
        except Exception as e:
            return None, str(e)[:200]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), batch_size):
                part = b.iloc[at : at + batch_size]
                texts = part[text].tolist()
                good = [t for t in texts if t is not None]
                try:
                    got = call(good) if good else []
                    if len(got) != len(good) or any(len(v) != dimension for v in got):
                        raise ValueError("wrong answer")
                    it = iter(got)
                    rows = [(next(it), None) if t is not None else (None, "no text") for t in texts]
                except Exception:
                    rows = [one(t) if t is not None else (None, "no text") for t in texts]
                yield pd.DataFrame({key: part[key], "embedding": [r[0] for r in rows], "error": [r[1] for r in rows]})

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<double>, error string")


def score_pairs(df: DataFrame, keys: list[str], left: str, right: str, model: Callable[[list[tuple[str, str]]], list[float]] = overlap_judge, batch_size: int = 64, attempts: int = 1) -> DataFrame:
    """Keys and ``model_score`` of text pairs, with the tokens that the call took (words of both)."""
    kinds = dict(df.dtypes)
    call = with_retry(model, attempts, 0.01)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), batch_size):
                part = b.iloc[at : at + batch_size]
                pairs = [(x or "", y or "") for x, y in zip(part[left], part[right])]
                out = part[keys].copy()
                out["model_score"] = call(pairs)
                out["tokens"] = [len(x.split()) + len(y.split()) for x, y in pairs]
                yield out

    return df.select(*dict.fromkeys([*keys, left, right])).mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", model_score double, tokens long")


def write_points(df: DataFrame, key: str, columns: list[str], write: Callable[[list[dict]], None], batch_size: int = 64, attempts: int = 1) -> DataFrame:
    """``key, error``: rows handed to ``write`` in batches of at most ``batch_size``.

    A batch that fails is written point by point, so a bad point costs only itself; its error is kept.
    Writing must be idempotent, as a lost task writes its batches again.
    """
    kind = dict(df.dtypes)[key]
    call = with_retry(write, attempts, 0.01)

    def one(point: dict) -> str | None:
        try:
            call([point])
        except Exception as e:
            return str(e)[:200]
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), batch_size):
                points = b.iloc[at : at + batch_size].to_dict("records")
                try:
                    call(points)
                    errors: list[str | None] = [None] * len(points)
                except Exception:
                    errors = [one(p) for p in points]
                yield pd.DataFrame({key: [p[key] for p in points], "error": errors})

    return df.select(*dict.fromkeys([key, *columns])).mapInPandas(run, f"{key} {kind}, error string")


def generate(df: DataFrame, key: str, prompt: str, model: Callable[[list[str]], list[str]] | None = None, max_tokens: int = 64) -> DataFrame:
    """``key, answer, prompt_tokens, completion_tokens``; the stand-in answers with the prompt's last
    words.  Answers are cut at max_tokens words."""
    kind = dict(df.dtypes)[key]
    call = model or (lambda prompts: [" ".join(p.split()[-8:]) for p in prompts])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            prompts = [p or "" for p in b[prompt]]
            answers = [" ".join(a.split()[:max_tokens]) for a in call(prompts)]
            yield pd.DataFrame({key: b[key], "answer": answers, "prompt_tokens": [len(p.split()) for p in prompts], "completion_tokens": [len(a.split()) for a in answers]})

    return df.select(key, prompt).mapInPandas(run, f"{key} {kind}, answer string, prompt_tokens long, completion_tokens long")
