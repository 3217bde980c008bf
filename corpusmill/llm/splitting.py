"""Cutting oversized texts into pieces at natural boundaries by dynamic programming.

Sizes are words (runs of characters other than white space).  Natural boundaries are line breaks,
form feeds, and white space after sentence punctuation.  Over all boundary positions those chains
of cuts are found that lack the fewest words of overlap (none, where any chain keeps it whole), and
of these the cheapest: a cut costs by its kind, a piece by its distance from the ideal size.  A piece
has at most ``limit`` words, its overlap with the piece before included.  Only a stretch that is
longer than the limit is cut between its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_SCHEMA = "id string, stamp string, text_hash long, section_path array<string>, piece int, word_start int, word_end int, overlap int, text string, page_start long, page_end long, cut string, forced boolean"
_WORD = re.compile(r"\S+")
_LINE_BREAK = re.compile("[\n\r\x0b\x85\u2028\u2029]")
_SENTENCE_END = re.compile(r"[.!?…][\"'”’»›)\]}“]*$")
# Cost of a cut by the boundary in front of the next word.
PAGE, PARAGRAPH, LINE, SENTENCE, FORCED = 0.0, 0.02, 0.06, 0.10, 4.0


@dataclass(frozen=True)
class Piece:
    start: int  # first word, the overlap included
    end: int  # behind the last word
    overlap: int  # words shared with the piece before
    kind: str  # natural or forced: how the piece's end was cut; end for the last


def boundaries(text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Spans of the words, and the cost of cutting in front of each word (FORCED inside a stretch)."""
    spans = [m.span() for m in _WORD.finditer(text)]
    cost = np.full(len(spans), FORCED)
    for i in range(1, len(spans)):
        gap = text[spans[i - 1][1] : spans[i][0]]
        if "\f" in gap:
            cost[i] = PAGE
        elif _LINE_BREAK.search(gap):
            cost[i] = PARAGRAPH if gap.count("\n") > 1 or "\u2029" in gap else LINE
        elif _SENTENCE_END.search(text, max(0, spans[i - 1][1] - 12), spans[i - 1][1]):
            cost[i] = SENTENCE
    return spans, cost


def has_long_stretch(cost: np.ndarray, limit: int) -> bool:
    at = np.append(np.append(0, np.flatnonzero(cost < FORCED)), len(cost))
    return bool((np.diff(at) > limit).any())


def split_words(cost: np.ndarray, limit: int, overlap: int) -> list[Piece]:
    """The cheapest pieces of ``len(cost)`` words among those that lack the least overlap; one piece if they fit the limit."""
    n = len(cost)
    if n <= limit:
        return [Piece(0, n, 0, "end")] if n else []
    overlap = max(0, min(overlap, limit - 1))
    natural = cost < FORCED
    # positions at which a cut may be: natural ones, and all inside stretches above the limit
    ends = np.append(np.flatnonzero(natural), n)
    starts = np.append(0, ends[:-1])
    may = natural.copy()
    for a, b in zip(starts, ends):
        if b - a > limit:
            may[a + 1 : b] = True
    at = np.append(np.append(0, np.flatnonzero(may)), n)
    at = np.unique(at)
    step = limit - overlap
    ideal = n / max(1, -(-(n - overlap) // max(1, step)))
    price = np.append(cost, 0.0)[at]
    price[-1] = 0.0
    best = np.full(len(at), np.inf)
    lost = np.zeros(len(at), np.int64)  # words of overlap that the best chain lacks
    back = np.zeros(len(at), np.int64)
    best[0] = 0.0
    for j in range(1, len(at)):
        lo = int(np.searchsorted(at, at[j] - limit, side="left"))
        i = np.arange(lo, j)
        fresh = at[j] - at[i]  # words that no earlier piece has
        shared = np.where(at[i] > 0, np.minimum(np.minimum(overlap, limit - fresh), at[i]), 0)
        lacking = lost[i] + np.where(at[i] > 0, np.minimum(overlap, at[i]) - shared, 0)
        off = (fresh - ideal) / limit
        lost[j] = lacking.min()
        total = np.where(lacking == lost[j], best[i] + off * off + price[j], np.inf)
        k = int(np.argmin(total))
        best[j], back[j] = total[k], i[k]
    cuts = []
    j = len(at) - 1
    while j:
        cuts.append((int(at[back[j]]), int(at[j])))
        j = int(back[j])
    cuts.reverse()
    pieces = []
    for a, b in cuts:
        shared = min(overlap, limit - (b - a), a) if a else 0
        pieces.append(Piece(a - shared, b, shared, "end" if b == n else "natural" if natural[b] else "forced"))
    return pieces


def split_text(text: str, limit: int, overlap_ratio: float) -> list[tuple[Piece, str, int, int, bool]]:
    """Pieces with their text, the form feeds before and inside them, and whether the text has a
    stretch above the limit.  Overlap is that share of the limit, in whole words."""
    spans, cost = boundaries(text)
    limit = max(1, limit)
    pieces = split_words(cost, limit, int(limit * max(0.0, overlap_ratio) + 1e-9))
    forced = has_long_stretch(cost, limit)
    out = []
    for p in pieces:
        a, b = spans[p.start][0], spans[p.end - 1][1]
        out.append((p, text[a:b], text.count("\f", 0, a), text.count("\f", a, b), forced))
    return out


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if r["text"] is None or len(r["text"]) < 2 * r["target_tokens"] or len(r["text"].split()) <= r["target_tokens"]:
                continue  # n words take at least 2n - 1 characters
            for k, (p, text, before, inside, forced) in enumerate(split_text(r["text"], r["target_tokens"], r["overlap_ratio"] or 0.0)):
                first = None if r["page_start"] is None else r["page_start"] + before
                rows.append((r["id"], r["stamp"], r["text_hash"], r["section_path"], k, p.start, p.end, p.overlap, text, first, None if first is None else first + inside, p.kind, forced))
        if rows:
            names = ["id", "stamp", "text_hash", "section_path", "piece", "word_start", "word_end", "overlap", "text", "page_start", "page_end", "cut", "forced"]
            types = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), *[pa.int32()] * 4, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def split_oversized(chunks: DataFrame, config: DataFrame) -> DataFrame:
    """Pieces of every chunk that has more words than its chunking_version allows.

    config: chunking_version, target_tokens, overlap_ratio, one row a version (a handful of rows).
    A chunk without text or with an unknown version is left as it is.  Of a key delivered several
    times the latest delivery counts (ties: the larger text hash).  Pages count on from page_start
    at each form feed; null page_start leaves the pages null.
    """
    source = chunks.where("chunk_id is not null and text is not null").select(F.col("chunk_id").alias("id"), F.coalesce("ingest.ingested_at", F.lit("")).alias("stamp"), F.xxhash64("text").alias("text_hash"), "section_path", "page_start", "text", "chunking_version")
    limits = config.where("chunking_version is not null and target_tokens > 0").groupBy("chunking_version").agg(F.max("target_tokens").alias("target_tokens"), F.max_by("overlap_ratio", "target_tokens").alias("overlap_ratio"))
    pieces = source.join(limits, "chunking_version").mapInArrow(_split, PIECE_SCHEMA)
    # a later delivery of a key may have another text, even one that fits: compare with all of them
    newest = source.groupBy("id").agg(F.max(F.struct("stamp", "text_hash")).alias("newest"))
    kept = pieces.join(newest, "id").where((F.col("stamp") == F.col("newest.stamp")) & (F.col("text_hash") == F.col("newest.text_hash")))
    return kept.dropDuplicates(["id", "piece"]).select(F.col("id").alias("chunk_id"), "piece", "section_path", "page_start", "page_end", "word_start", "word_end", "overlap", "cut", "forced", "text")
