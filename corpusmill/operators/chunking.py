"""Chunking of documents: sentences with their pages, greedy packing with overlap, re-splitting.

Packing depends on the window before, so it runs document by document in grouped Python; documents
are independent and spread over all tasks.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BLANKS, collapse, sentences


def pack_windows(counts: list[int], target: int, overlap_ratio: float) -> list[tuple[int, int]]:
    """Windows ``[start, end)`` of sentences with at least ``target`` tokens each (the last may have
    fewer).  The next window starts so that the shared suffix has at least ceil(total * ratio)
    tokens; a window that wouldn't advance starts one sentence later."""
    windows = []
    start, n = 0, len(counts)
    while start < n:
        total, end = 0, start
        while end < n and total < target:
            total += counts[end]
            end += 1
        windows.append((start, end))
        if end >= n:
            break
        want = math.ceil(total * overlap_ratio)
        shared, nxt = 0, end
        while nxt > start and shared < want:
            nxt -= 1
            shared += counts[nxt]
        if nxt <= start:
            nxt = end if end - start == 1 else start + 1
        start = nxt
    return windows


def sentence_units(pages: DataFrame, key: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """``key, sent_idx, sentence, page, tokens``: sentences in page order; blank pages give none."""
    rows = pages.select(key, page, F.posexplode(sentences(collapse(F.col(text)))).alias("_pos", "sentence"))
    order = Window.partitionBy(key).orderBy(page, "_pos")
    tokens = F.size(F.split(F.trim("sentence"), BLANKS))
    return rows.select(key, (F.row_number().over(order) - 1).alias("sent_idx"), "sentence", F.col(page).alias("page"), tokens.alias("tokens"))


def fixed_chunks(units: DataFrame, target: int, overlap_ratio: float, key: str = "doc_id") -> DataFrame:
    """``key, chunk_index, start_idx, end_idx, tokens, page_start, page_end, text``."""
    kind = dict(units.dtypes)[key]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("sent_idx", kind="stable")
        counts, pages, texts = g["tokens"].tolist(), g["page"].tolist(), g["sentence"].tolist()
        rows = [(g[key].iloc[0], k, a, b, sum(counts[a:b]), min(pages[a:b]), max(pages[a:b]), " ".join(texts[a:b])) for k, (a, b) in enumerate(pack_windows(counts, target, overlap_ratio))]
        return pd.DataFrame(rows, columns=[key, "chunk_index", "start_idx", "end_idx", "tokens", "page_start", "page_end", "text"])

    return units.groupBy(key).applyInPandas(run, f"{key} {kind}, chunk_index int, start_idx int, end_idx int, tokens int, page_start long, page_end long, text string")


def resplit(parents: DataFrame, target: int, overlap_ratio: float) -> DataFrame:
    """Every parent chunk packed anew; children carry its section path, pages and document and get
    positions within the document.  Parents without text give none."""
    pages = parents.select(F.col("chunk_id"), F.col("page_start").alias("page"), "text")
    children = fixed_chunks(sentence_units(pages, "chunk_id"), target, overlap_ratio, "chunk_id").withColumnRenamed("chunk_index", "part").drop("page_start", "page_end")
    rows = children.join(parents.select("chunk_id", "doc_id", F.col("chunk_index").alias("parent_index"), "section_path", "page_start", "page_end"), "chunk_id")
    order = Window.partitionBy("doc_id").orderBy("parent_index", "chunk_id", "part")
    return rows.withColumn("chunk_index", F.row_number().over(order) - 1)


def page_cursor(marks: DataFrame, key: str, order: str, page: str) -> DataFrame:
    """Carry the last known page forward over rows without one."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return marks.withColumn(page, F.last(page, ignorenulls=True).over(w))


def shared_suffix(a: Column, b: Column) -> Column:
    """Greatest k with the last k elements of a equal to the first k of b."""
    sizes = F.sequence(F.lit(0), F.greatest(F.lit(0), F.least(F.size(a), F.size(b))))
    return F.coalesce(F.array_max(F.filter(sizes, lambda k: F.slice(a, F.size(a) - k + 1, k) == F.slice(b, F.lit(1), k))), F.lit(0))


def numeric_path(label: Column) -> Column:
    """``10.2.1`` as an array of numbers, so that 10.2 sorts behind 9.9; other parts become null."""
    return F.transform(F.split(label, r"\."), lambda x: F.expr("int(null)") if x is None else x.try_cast("int"))


def section_tree(sections: DataFrame, residual_min: int = 1) -> DataFrame:
    """Leaf and residual spans of a section tree.

    sections: doc_id, id, parent (null for roots), start, end.  A section without children is one
    span.  What its children leave of a parent is its own span before the first child and behind the
    last; a gap between two children goes to the child in front of it.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["start", "end", "id"])
        kids: dict = {}
        for r in g.itertuples(index=False):
            kids.setdefault(None if pd.isna(r.parent) else r.parent, []).append(r)
        rows: list[list] = []

        def emit(node) -> None:
            children = kids.get(node.id, [])
            if not children:
                rows.append([node.doc_id, node.id, int(node.start), int(node.end), "leaf"])
                return
            if children[0].start - node.start >= residual_min:
                rows.append([node.doc_id, node.id, int(node.start), int(children[0].start) - 1, "leading"])
            reach = node.start - 1
            for k, child in enumerate(children):
                if k and child.start - 1 > reach:
                    rows[-1][3] = int(child.start) - 1  # a middle gap extends the child before
                emit(child)
                reach = max(reach, child.end)
            if node.end - reach >= residual_min:
                rows.append([node.doc_id, node.id, int(reach) + 1, int(node.end), "trailing"])

        for root in kids.get(None, []):
            emit(root)
        return pd.DataFrame(rows, columns=["doc_id", "id", "start", "end", "kind"])

    return sections.groupBy("doc_id").applyInPandas(run, "doc_id long, id string, start long, end long, kind string")
