"""Token counts with a public subword tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: File of the tokenizer: .tiktoken (ranks), .json (tokenizers) or .model (sentencepiece).
DEFAULT_TOKENIZER = os.environ.get("CORPUSMILL_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the public pre-tokenization pattern of the byte-level BPE vocabularies.
BYTE_BPE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pieces of text whose counts a task keeps.
HELD_PIECES = 500_000


def _byte_bpe(path: str) -> Callable[[str], int]:
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    encode = tiktoken.Encoding("file", pat_str=BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    held: dict[str, int] = {}

    def piece(text: str) -> int:
        n = held.get(text)
        if n is None:
            if len(held) >= HELD_PIECES:
                held.clear()
            n = len(encode(text))
            if len(text) <= 64:
                held[text] = n
        return n

    def count(text: str) -> int:
        # The pattern never crosses a single blank between two other characters, so the pieces
        # between blanks can be counted one by one; runs of white space take the direct way.
        parts = text.split(" ")
        if "" in parts or len(parts) == 1:
            return len(encode(text))
        return piece(parts[0]) + sum([piece(" " + p) for p in parts[1:]])

    return count


def _hf(path: str) -> Callable[[str], int]:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def _piece(path: str) -> Callable[[str], int]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda text: len(model.encode(text))


_LOADED: dict[str, Callable[[str], int]] = {}


def counter(path: str = DEFAULT_TOKENIZER) -> Callable[[str], int]:
    if path not in _LOADED:
        kind = path.rsplit(".", 1)[-1]
        _LOADED[path] = {"tiktoken": _byte_bpe, "json": _hf, "model": _piece}[kind](path)
    return _LOADED[path]


def sized(df: DataFrame, key: str, text: str, stamp: str | None = None, keep: dict | None = None, path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``key`` (long), ``tokens`` and the columns of ``keep`` (name to expression of a string), one
    row a key: of several deliveries the one with the latest stamp (ties: the larger text hash).

    A null or empty text has 0 tokens; rows without a key are left out.
    """
    keep = keep or {}
    kept = list(keep)
    when = F.unix_micros(F.col(stamp).cast("timestamp")) if stamp else F.lit(0)
    source = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.coalesce(when, F.lit(0)).cast("long").alias("stamp"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"), *[e.cast("string").alias(c) for c, e in keep.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            tokens = pa.array([count(t) if t else 0 for t in batch["text"].to_pylist()], pa.int64())
            yield pa.record_batch([batch["key"], batch["stamp"], batch["text_hash"], tokens, *[batch[c] for c in kept]], names=["key", "stamp", "text_hash", "tokens", *kept])

    schema = "key long, stamp long, text_hash long, tokens long" + "".join(f", {c} string" for c in keep)
    latest = F.max_by(F.struct("tokens", *keep), F.struct("stamp", "text_hash"))
    return source.mapInArrow(run, schema).groupBy("key").agg(latest.alias("s")).select(F.col("key").alias(key), "s.*")
