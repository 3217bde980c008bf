"""Clean-up of positioned words of a page: superscripts, block rules, line rules, two columns.

A page is an array of words ``text, top, x0, size, bottom``; the rules of a page are sequential, so
pages go through Arrow batches, many at a time, and are independent of each other.  Order: superscripts,
blocks before the line rules, line rules, blocks after them, lines joined by line feeds, substitutions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame

WORD = "array<struct<text:string,top:double,x0:double,size:double,bottom:double>>"
RULED = "array<struct<top:double,x0:double,x1:double,linewidth:double>>"


@dataclass(frozen=True)
class TextAnchor:
    """Lines that match a pattern; ``first``: only the first of them."""

    pattern: str
    first: bool = False


@dataclass(frozen=True)
class RuledAnchor:
    """The lowest drawn line that begins far enough down and left and is neither too short, too long
    nor too thick."""

    from_share: float = 0.0
    x0_most: float = float("inf")
    width: tuple[float, float] = (0.0, float("inf"))
    linewidth_most: float = float("inf")


@dataclass(frozen=True)
class BlockRule:
    """What to drop from an anchor on: with a text anchor its line and the following ones, at most
    ``most_lines`` and not beyond a gap of a reference times a factor (``stops``: name, factor); with a
    ruled anchor all words from ``offset`` below it.  references: (name, median_gap or
    median_word_font_size_above_anchor, fallback).  when: a tree of all, any and not over the kinds of ``LEAVES``; only
    where it holds the block is dropped."""

    anchor: TextAnchor | RuledAnchor
    before_lines: bool = False
    most_lines: int = 1
    stops: tuple[tuple[str, float], ...] = ()
    references: tuple[tuple[str, str, float], ...] = ()
    offset: float = 0.0
    when: dict | None = None


@dataclass(frozen=True)
class PageRules:
    """y_tolerance: words within it of a line's top belong to the line.  superscripts: digits of at
    most so many characters and at most this share of the median size are dropped.  drop_lines:
    (kind, value, band) with kind prefix, equals or regex and band top, bottom or any.  blocks: see
    ``BlockRule``.  columns_at: x at which the page is read as two columns, the left one first.
    chapter_of: the chapter of a page, for conditions."""

    y_tolerance: float = 3.0
    superscript_digits: int = 3
    superscript_ratio: float = 0.75
    drop_lines: tuple = ()
    blocks: tuple[BlockRule, ...] = ()
    columns_at: float | None = None
    substitutions: tuple = ()
    terms: dict = field(default_factory=dict)
    band: float = 0.1
    chapter_of: dict = field(default_factory=dict)


@dataclass
class Found:
    """What a condition may look at: the page, the anchor's match (None for drawn lines), and the
    candidate lines or words."""

    page: int | None
    chapter_of: dict
    match: re.Match | None
    lines: list
    words: list
    references: dict[str, float]


def _captured_chapter(leaf: dict) -> Callable[[Found], bool]:
    def holds(f: Found) -> bool:
        chapter = f.chapter_of.get(f.page)
        try:
            return f.match is not None and isinstance(chapter, int) and int(f.match.group(int(leaf["capture_group"]))) == chapter
        except (IndexError, TypeError, ValueError):
            return False

    return holds


def _word_at(leaf: dict, test: Callable[[dict], bool]) -> Callable[[Found], bool]:
    k = int(leaf["word_index"])
    return lambda f: 0 <= k < len(f.words) and test(f.words[k])


def _matching_word(leaf: dict) -> Callable[[Found], bool]:
    pattern = re.compile(leaf["pattern"])
    return _word_at(leaf, lambda w: pattern.search(w["text"]) is not None)


def _all_small(leaf: dict) -> Callable[[Found], bool]:
    ignored, factor = re.compile(leaf["ignore_first_word_if_matches"]), float(leaf["value"])

    def holds(f: Found) -> bool:
        usual = f.references.get(leaf["reference"], 0.0)
        judged = f.words[1:] if f.words and ignored.search(f.words[0]["text"]) else f.words
        return usual > 0 and all(w["size"] <= usual * factor for w in judged)

    return holds


# The names of the conditions' kinds.
LEAVES: dict[str, Callable[[dict], Callable[[Found], bool]]] = {
    "anchor_capture_int_eq_context": _captured_chapter,
    "candidate_line_count_gte": lambda leaf: lambda f: len(f.lines) >= int(leaf["value"]),
    "word_below_anchor_regex_at_index": _matching_word,
    "word_below_anchor_size_lte_at_index": lambda leaf: _word_at(leaf, lambda w: w["size"] <= float(leaf["value"])),
    "all_words_below_anchor_size_ratio_lte": _all_small,
}


def condition(tree: dict | None) -> Callable[[Found], bool]:
    """A tree of conditions as a function; None always holds."""
    if tree is None:
        return lambda f: True
    for name, join in (("all", all), ("any", any)):
        if name in tree:
            parts = [condition(t) for t in tree[name]]
            return lambda f: join(p(f) for p in parts)
    if "not" in tree:
        part = condition(tree["not"])
        return lambda f: not part(f)
    return LEAVES[tree["kind"]](tree)


def group_lines(words: list[dict], tolerance: float) -> list[list[dict]]:
    """Words by lines: a word joins the line whose least top, that of its first word, is within the
    tolerance."""
    lines: list[list[dict]] = []
    for w in sorted(words, key=lambda w: (w["top"], w["x0"], w["text"])):
        if lines and w["top"] - lines[-1][0]["top"] <= tolerance:
            lines[-1].append(w)
        else:
            lines.append([w])
    return [sorted(line, key=lambda w: (w["x0"], w["top"], w["text"])) for line in lines]


def line_text(line: list[dict]) -> str:
    return " ".join(w["text"] for w in line)


def without_superscripts(words: list[dict], digits: int, ratio: float) -> list[dict]:
    sizes = [w["size"] for w in words if w["text"].strip()]
    usual = median(sizes) if sizes else 0.0
    if usual <= 0:
        return list(words)
    return [w for w in words if not (w["text"].isdecimal() and len(w["text"]) <= digits and w["size"] <= ratio * usual)]


def _gap(a: list[dict], b: list[dict]) -> float:
    return max(0.0, min(w["top"] for w in b) - max(w["bottom"] for w in a))


def line_gaps(lines: list[list[dict]]) -> list[float]:
    """Blank height between each line and the next, never below 0."""
    return [_gap(a, b) for a, b in zip(lines, lines[1:])]


def _line_hit(line: list[dict], height: float, rule: tuple, band: float) -> bool:
    kind, value, where = rule
    text, top = line_text(line), min(w["top"] for w in line)
    if where == "top" and not top < band * height or where == "bottom" and not top > (1 - band) * height:
        return False
    return text.lstrip().startswith(value) if kind == "prefix" else text == value if kind == "equals" else re.search(value, text) is not None


def _references(rule: BlockRule, lines: list[list[dict]], words: list[dict], above: float) -> dict[str, float]:
    out = {}
    for name, kind, fallback in rule.references:
        values = [g for g in line_gaps(lines) if g > 0] if kind == "median_gap" else [w["size"] for w in words if w["top"] < above]
        out[name] = median(values) if values else fallback
    return out


def candidate_lines(lines: list[list[dict]], at: int, most: int, stops: tuple, references: dict[str, float]) -> list[list[dict]]:
    """The line at ``at`` and the following ones up to a gap that a stop names, or ``most`` lines."""
    end = at + 1
    while end < min(len(lines), at + most):
        gap = _gap(lines[end - 1], lines[end])
        if any(references.get(name, 0.0) > 0 and gap >= references[name] * factor for name, factor in stops):
            break
        end += 1
    return lines[at:end]


def lowest_rule(ruled: list[dict], height: float, anchor: RuledAnchor) -> float | None:
    """Top of the lowest drawn line that fits; lines with a missing number don't."""
    tops = []
    for r in ruled:
        if any(r[k] is None for k in ("top", "x0", "x1", "linewidth")):
            continue
        if r["top"] >= anchor.from_share * height and r["x0"] <= anchor.x0_most and anchor.width[0] <= r["x1"] - r["x0"] <= anchor.width[1] and r["linewidth"] <= anchor.linewidth_most:
            tops.append(r["top"])
    return max(tops, default=None)


def drop_blocks(words: list[dict], ruled: list[dict], height: float, page: int | None, rules: PageRules, before_lines: bool) -> list[dict]:
    """The words left after the block rules of one stage, in their order.

    A text anchor is looked for again after each block that was dropped, as lines may have changed.
    """
    for rule in rules.blocks:
        if rule.before_lines != before_lines:
            continue
        holds = condition(rule.when)
        if isinstance(rule.anchor, RuledAnchor):
            top = lowest_rule(ruled, height, rule.anchor)
            if top is not None:
                below = sorted((w for w in words if w["top"] >= top + rule.offset), key=lambda w: (w["top"], w["x0"], w["text"]))
                known = _references(rule, group_lines(words, rules.y_tolerance), words, top)
                if holds(Found(page, rules.chapter_of, None, [], below, known)):
                    gone = set(map(id, below))
                    words = [w for w in words if id(w) not in gone]
            continue
        again = True
        while again:
            again = False
            lines = group_lines(words, rules.y_tolerance)
            known = _references(rule, lines, words, float("inf"))
            hits = ((i, m) for i, line in enumerate(lines) if (m := re.search(rule.anchor.pattern, line_text(line))))
            for i, match in hits:
                block = candidate_lines(lines, i, rule.most_lines, rule.stops, known)
                if holds(Found(page, rules.chapter_of, match, block, [], known)):
                    gone = {id(w) for line in block for w in line}
                    words = [w for w in words if id(w) not in gone]
                    again = True
                    break
                if rule.anchor.first:
                    break
    return words


def clean_words(words: list[dict], height: float, rules: PageRules, page: int | None = None, ruled: list[dict] | None = None) -> str:
    sides = [words] if rules.columns_at is None else [[w for w in words if w["x0"] < rules.columns_at], [w for w in words if w["x0"] >= rules.columns_at]]
    out = []
    for side in sides:
        side = without_superscripts(side, rules.superscript_digits, rules.superscript_ratio)
        side = drop_blocks(side, ruled or [], height, page, rules, before_lines=True)
        kept = [line for line in group_lines(side, rules.y_tolerance) if not any(_line_hit(line, height, r, rules.band) for r in rules.drop_lines)]
        side = drop_blocks([w for line in kept for w in line], ruled or [], height, page, rules, before_lines=False)
        text = "\n".join(map(line_text, group_lines(side, rules.y_tolerance)))
        for pattern, replacement in rules.substitutions:
            text = re.sub(pattern, replacement, text)
        out.append(text.replace("\0", ""))
    text = "\n".join(t for t in out if t)
    for old, new in rules.terms.items():
        text = text.replace(old, new)
    return " ".join(text.split())


def clean_pages(pages: DataFrame, rules: PageRules) -> DataFrame:
    """``doc_id, page, clean_text``; a null array of words gives an empty text.  A column ``ruled`` of
    drawn lines is used if there is one."""
    drawn = "ruled" in pages.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ruled = b["ruled"] if drawn else [None] * len(b)
            text = [
                clean_words([dict(w) for w in words] if words is not None else [], h if h is not None else 0.0, rules, int(p), [dict(r) for r in lines] if lines is not None else [])
                for words, h, p, lines in zip(b["words"], b["page_height"], b["page"], ruled)
            ]
            yield pd.DataFrame({"doc_id": b["doc_id"], "page": b["page"], "clean_text": text})

    kind = dict(pages.dtypes)
    return pages.select("doc_id", "page", "words", "page_height", *(["ruled"] if drawn else [])).mapInPandas(run, f"doc_id {kind['doc_id']}, page {kind['page']}, clean_text string")
