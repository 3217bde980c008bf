"""Pages that are keywords, links, navigation, tags or products instead of sentences.

Every page's rank-frequency curve (log frequency over log rank of its words) is fitted with SQL
windows.  Prose pages (few words outside sentences) of the same language and comparable length say
what prose looks like, however many other pages there are: the quartiles of their curves, and how
often they use each of their frequent words.  A page whose slope, residual or variety lies far from
theirs, or whose words diverge from theirs (Jensen-Shannon), is flagged; no other page is spam.
Honest lists and steps are flagged too, so an exact reading of the flagged pages follows, which
counts the words that stand outside sentences.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .answers import _WORDS

_WORD = re.compile(r"[^\W_]+")
_END = re.compile(r"[.!?…][\"'”’»)\]]*(?=\s|$)")
_HEADING = re.compile(r"^#{1,6}\s+[^#\s]")
_BROKEN = re.compile(r"([^\W\d_])-\n([^\W\d_])")
_ITEM = re.compile(r"^\s*(?:#{1,6}\s+|>+\s*)?(?:(\(?\d{1,3}[.)])|[-*•+–])\s+")
_URL = re.compile(r"(?:https?://|www\.)\S+|\[[^\]\n]*\]\([^)\n]*\)")
_CODE_LINE = re.compile(r"^\s*(?:[$>]\s+\S|(?:ctl|sudo|kubectl|curl|ssh|git|export|set|systemctl)\s+\S|[\w.\-\[\]/]+\s*(?:=|:=)\s*\S|[\w\-]*[._][\w.\-]+\s*:\s*\S+\s*$)")
_SETTING = re.compile(r"^\s*[\w.\-]+\s*[:=]\s*[\w.\-/%\"']+\s*$")
_FUNCTION = frozenset().union(*_WORDS.values())
_TAGGED = re.compile(r"^\s*(?:tags?|keywords?|labels?|categor(?:y|ies)|schlagw[oö]rter|stichw[oö]rter|mots[- ]cl[eé]s|etiquetas|palabras clave)\s*:", re.I)
SCAN_SCHEMA = "doc_id long, stamp timestamp, text_hash long, lang string, words int, spectrum array<struct<f:int,c:int>>, outside double, size int, word string, n long"
#: Words a task holds before it hands on its partial counts.
HELD_WORDS = 400_000


def _lines(text: str) -> Iterator[tuple[str, bool]]:
    """Lines without blanks around, and whether they are in a code block."""
    fenced = False
    for line in _BROKEN.sub(r"\1\2", text.replace("\xa0", " ")).split("\n"):
        if line.lstrip().startswith("```"):
            fenced = not fenced
            continue
        if line.strip():
            yield line.strip(), fenced


def words_outside(text: str) -> tuple[int, int]:
    """Words outside sentences that are keywords, links, navigation, tags or products; all words.

    Sentences, headings, commands, settings and code are not counted as outside.  A sentence that
    repeats a phrase which the whole page repeats is stuffing.
    """
    total = outside = 0
    pairs: Counter = Counter()
    single: Counter = Counter()
    bare: list[list[str]] = []  # punctuated like sentences, but without any function word
    worded: list[list[str]] = []
    for line, code in _lines(text.lower()):
        if code or (_HEADING.match(line) and "#" not in line.lstrip("#")) or _CODE_LINE.match(line) or (_SETTING.match(line) and not _URL.search(line)):
            total += len(_WORD.findall(line))
            continue
        if _TAGGED.match(line):
            n = len(_WORD.findall(line))
            total += n
            outside += n
            continue
        item = _ITEM.match(line)
        numbered = bool(item and item.group(1))
        body = line[item.end() :] if item else line
        total += numbered
        linked = "://" in body or "www." in body or "](" in body
        at = 0
        for m in _END.finditer(body):
            part = body[at : m.end()]
            at = m.end()
            got = _WORD.findall(part)
            if not got:
                continue
            total += len(got)
            if linked and _URL.search(part) and len(_WORD.findall(_URL.sub(" ", part))) < 4:
                outside += len(got)
            elif len(got) >= 9 and len(set(got)) < 0.45 * len(got):
                outside += len(got)
            elif not numbered and _FUNCTION.isdisjoint(got):
                pairs.update(zip(got, got[1:]))
                bare.append(got)
            else:
                content = [w not in _FUNCTION for w in got]
                pairs.update([p for p, x, y in zip(zip(got, got[1:]), content, content[1:]) if x and y])
                single.update([w for w, x in zip(got, content) if x])
                if not numbered:
                    worded.append(got)
        tail = _WORD.findall(body[at:])
        if tail:
            total += len(tail)
            if not (numbered and len(tail) <= 25 and not (linked and _URL.search(body))):
                outside += len(tail)
    for got in bare:
        again = sum(pairs[p] >= 3 for p in zip(got, got[1:]))
        if len(got) > 1 and again >= 0.4 * (len(got) - 1):
            outside += len(got)
    often, common = max(3, 0.01 * total), max(4, 0.05 * total)
    phrases, keywords = {p for p, n in pairs.items() if n >= often}, {w for w, n in single.items() if n >= common}
    if phrases or keywords:
        outside += sum([len(got) for got in worded if _is_stuffed(got, phrases, keywords)])
    return outside, total


def _is_stuffed(got: list[str], phrases: set, keywords: set) -> bool:
    """Phrases that the page repeats again and again make up more than a quarter of a sentence that
    repeats one of them itself, or two fifths of any sentence."""
    hits = [k for k, p in enumerate(zip(got, got[1:])) if p in phrases]
    words = [] if keywords.isdisjoint(got) else [k for k, w in enumerate(got) if w in keywords]
    if not hits and not words:
        return False
    share = len({*hits, *[k + 1 for k in hits], *words}) / len(got)
    if share < 0.27:
        return False
    repeated = len({(got[k], got[k + 1]) for k in hits}) < len(hits) or len({got[k] for k in words}) < len(words)
    return share >= 0.4 or repeated


def _language(counts: Counter) -> str | None:
    score = {lang: sum([counts[w] for w in known & counts.keys()]) for lang, known in _WORDS.items()}
    best = max(score, key=score.get)
    return best if score[best] else None


def _size(words: int) -> int:
    """The power of two below the number of words."""
    return words.bit_length() - 1


_SCANNED = pa.schema([("doc_id", pa.int64()), ("stamp", pa.timestamp("us", tz="UTC")), ("text_hash", pa.int64()), ("lang", pa.string()), ("words", pa.int32()), ("spectrum", pa.list_(pa.struct([("f", pa.int32()), ("c", pa.int32())]))), ("outside", pa.float64()), ("size", pa.int32()), ("word", pa.string()), ("n", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _scan(prose: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used: dict[tuple, Counter] = {}

        def hand_on() -> pa.RecordBatch:
            return _batch([(None, None, None, lang, None, None, None, size, w, n) for (lang, size), counts in used.items() for w, n in counts.items()], _SCANNED)

        for batch in batches:
            rows = []
            for doc, stamp, text_hash, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "stamp", "text_hash", "text"))):
                found = _WORD.findall(text.lower())
                counts = Counter(found)
                lang = _language(counts)
                spectrum = [{"f": f, "c": c} for f, c in sorted(Counter(counts.values()).items(), reverse=True)]
                outside, total = words_outside(text)
                share = outside / total if total else 0.0
                if lang is not None and share <= prose:
                    cell = used.setdefault((lang, _size(len(found))), Counter())
                    cell.update(counts)
                rows.append((doc, stamp, text_hash, lang, len(found), spectrum, share, _size(len(found)), None, None))
            yield _batch(rows, _SCANNED)
            if sum(map(len, used.values())) > HELD_WORDS:
                yield hand_on()
                used = {}
        yield hand_on()

    return run


def _source(documents: DataFrame) -> DataFrame:
    return documents.where("doc_id is not null and text is not null").select("doc_id", F.col("fetched_at").cast("timestamp").alias("stamp"), F.xxhash64("text").alias("text_hash"), "text")


def prose_usage(counted: DataFrame, floor: float) -> dict[tuple, dict[str, float]]:
    """The share of each word among all words of prose, by (language, size), (language, None) and
    (None, None).

    Words below ``floor`` are left to the rest, so each level has at most 1 / floor words.  counted:
    lang, size, word, n.
    """
    levels = counted.groupingSets([["lang", "size", "word"], ["lang", "word"], ["word"]], "lang", "size", "word").agg(F.sum("n").alias("n"))
    total = counted.groupingSets([["lang", "size"], ["lang"], []], "lang", "size").agg(F.sum("n").alias("total"))
    same = (F.col("a.lang").eqNullSafe(F.col("b.lang"))) & (F.col("a.size").eqNullSafe(F.col("b.size")))
    shares = levels.alias("a").join(F.broadcast(total.alias("b")), same).where(F.col("n") >= floor * F.col("total")).select("a.lang", "a.size", "word", (F.col("n") / F.col("total")).alias("share"))
    out: dict[tuple, dict[str, float]] = {}
    for row in shares.collect():  # at most 1 / floor words of each language and power of two
        out.setdefault((row["lang"], row["size"]), {})[row["word"]] = row["share"]
    return out


def divergence(counts: Counter, usage: dict[str, float], used: float) -> float:
    """Jensen-Shannon divergence in bits between a page's words and a usage, whose listed words have
    the share ``used``; all words that the usage doesn't list are one.

    A listed word that the page lacks adds its own share, so only the page's words are gone through.
    """
    n, bits, listed = counts.total(), used, 0.0
    for w, c in counts.items():
        q = usage.get(w)
        if q:
            p = c / n
            listed += p
            bits += p * math.log2(2 * p / (p + q)) + q * (math.log2(2 * q / (p + q)) - 1)
    p, q = max(0.0, 1 - listed), max(0.0, 1 - used)
    bits += (p * math.log2(2 * p / (p + q)) if p > 1e-12 else 0.0) + (q * math.log2(2 * q / (p + q)) if q > 1e-12 else 0.0)
    return bits / 2


def _diverge(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("divergence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usage = {k: (v, sum(v.values())) for k, v in shared.value.items()}
        for batch in batches:
            rows = []
            for doc, text_hash, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "text_hash", "text"))):
                counts = Counter(_WORD.findall(text.lower()))
                if counts:
                    lang = _language(counts)
                    like = usage.get((lang, _size(counts.total()))) or usage.get((lang, None)) or usage.get((None, None)) or ({}, 0.0)
                    rows.append((doc, text_hash, divergence(counts, *like)))
            yield _batch(rows, schema)

    return run


def scan_pages(documents: DataFrame, prose: float = 0.25, floor: float = 1e-3, least_words: int = 10_000) -> DataFrame:
    """One row a document with its word-frequency spectrum, its divergence from prose and the share
    of its words outside sentences (of a key delivered several times the latest fetch, ties by text
    hash).  Null keys and texts are left out.

    Prose is compared at the page's language and length where its pages there have ``least_words``
    words, else at its language, else with all prose; every delivery of a prose page speaks for it.
    """
    spark = documents.sparkSession
    source = _source(documents)
    scanned = materialise(source.mapInArrow(_scan(prose), SCAN_SCHEMA), "pages")
    usage = prose_usage(scanned.where("doc_id is null").select("lang", "size", "word", "n"), floor)
    ample = scanned.where("doc_id is null").groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()  # a row for each language and power of two
    for row in ample:
        if row["n"] < least_words:
            usage.pop((row["lang"], row["size"]), None)
    diverging = source.select("doc_id", "text_hash", "text").mapInArrow(_diverge(spark.sparkContext.broadcast(usage)), "doc_id long, text_hash long, divergence double")
    # both rows of a text meet in the aggregation that picks a key's latest delivery
    pages = scanned.where("doc_id is not null").select("doc_id", "text_hash", "stamp", "lang", "words", "spectrum", "outside", F.lit(None).cast("double").alias("divergence"))
    diverging = diverging.select("doc_id", "text_hash", *[F.lit(None).cast(pages.schema[c].dataType).alias(c) for c in ("stamp", "lang", "words", "spectrum", "outside")], "divergence")
    own = F.max_by(F.struct("stamp", "lang", "words", "spectrum", "outside"), F.when(F.col("words").isNotNull(), F.coalesce("stamp", F.timestamp_micros(F.lit(0))))).alias("p")
    texts = pages.unionByName(diverging).groupBy("doc_id", "text_hash").agg(own, F.max("divergence").alias("divergence"))
    newest = F.max_by(F.struct("p.lang", "p.words", "p.spectrum", "divergence", "p.outside"), F.struct(F.coalesce("p.stamp", F.timestamp_micros(F.lit(0))), "text_hash"))
    return texts.groupBy("doc_id").agg(newest.alias("p")).select("doc_id", "p.*")


def fit_curves(pages: DataFrame) -> DataFrame:
    """Slope, residual and head share of each page's rank-frequency curve.

    A spectrum entry (f, c) stands for c words of equal frequency f; the window over the page's
    entries gives the ranks they fill, and they enter the regression at their middle rank with
    weight one, so that the long tail of rare words doesn't decide alone.
    """
    points = pages.select("doc_id", "words", F.explode("spectrum").alias("s")).select("doc_id", "words", "s.f", "s.c")
    above = Window.partitionBy("doc_id").orderBy(F.desc("f")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = points.withColumn("before", F.coalesce(F.sum("c").over(above), F.lit(0)))
    ranked = ranked.select("doc_id", "words", F.log(F.col("before") + (F.col("c") + 1) / 2.0).alias("x"), F.log(F.col("f").cast("double")).alias("y"), (F.col("f") * F.col("c")).alias("mass"), "c")
    n, sx, sy = F.count("*"), F.sum("x"), F.sum("y")
    sxx, sxy, syy = F.sum(F.col("x") * F.col("x")), F.sum(F.col("x") * F.col("y")), F.sum(F.col("y") * F.col("y"))
    sums = ranked.groupBy("doc_id").agg(n.alias("n"), sx.alias("sx"), sy.alias("sy"), sxx.alias("sxx"), sxy.alias("sxy"), syy.alias("syy"), F.sum("c").alias("distinct_words"), F.max("words").alias("words"))
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vxy = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    slope = F.when((F.col("n") > 1) & (vx > 1e-12), vxy / vx).otherwise(F.lit(0.0))
    fitted = sums.withColumn("slope", slope).withColumn("residual", F.sqrt(F.greatest(F.lit(0.0), vy - F.col("slope") * vxy) / F.col("n")))
    return fitted.select("doc_id", "slope", "residual", (F.col("distinct_words") / F.col("words")).alias("variety"))


def flag_pages(pages: DataFrame, spread: float = 2.0, least_peers: int = 30, half: float = 0.5, prose: float = 0.25) -> DataFrame:
    """Pages with curve, flag and the exact share of words outside sentences.

    Peers are the prose pages (at most ``prose`` of the words outside sentences) of the same language
    and of a length within the same power of two; with fewer than ``least_peers`` those of the
    language are, then all prose pages.  A page is flagged if slope, residual or variety lies more
    than ``spread`` robust deviations from its peers' median, if its divergence from prose lies as far
    above theirs, or if there is no prose of its language to compare with, as it has no language's
    words or no page is prose.  A page is spam if it is flagged and the
    exact reading finds more than ``half`` of its words outside sentences.
    """
    curves = pages.select("doc_id", F.coalesce("lang", F.lit("?")).alias("lang"), F.floor(F.log2(F.col("words").cast("double"))).cast("int").alias("size"), "words", "divergence", "outside").where("words > 0").join(fit_curves(pages), "doc_id")
    curves = materialise(curves, "curves")
    measures = ["slope", "residual", "variety", "divergence"]
    quartiles = [F.percentile_approx(m, [0.25, 0.5, 0.75], 1000).alias(m) for m in measures]
    levels = curves.where(F.col("outside") <= prose).groupingSets([["lang", "size"], ["lang"], []], "lang", "size").agg(F.count("*").alias("peers"), *quartiles)
    levels = levels.where((F.col("peers") >= least_peers) | (F.col("lang").isNull() & F.col("size").isNull()))
    # a row for each language and power of two of lengths: some hundred at most
    fine = F.broadcast(levels.where("lang is not null and size is not null").select("lang", "size", F.struct(*measures).alias("fine")))
    mid = F.broadcast(levels.where("lang is not null and size is null").select("lang", F.struct(*measures).alias("mid")))
    whole = F.broadcast(levels.where("lang is null and size is null").select(F.struct(*measures).alias("whole")))
    joined = curves.join(fine, ["lang", "size"], "left").join(mid, "lang", "left").join(whole, F.lit(True), "left")
    peers = F.coalesce(F.when(F.col("lang") != "?", F.col("fine")), F.when(F.col("lang") != "?", F.col("mid")), F.col("whole"))
    joined = joined.withColumn("peers", peers)

    def far(m: str):
        low, mid_, high = (F.col(f"peers.{m}")[i] for i in range(3))
        return (F.col(m) - mid_) / (F.greatest(high - low, F.lit(0.02)) / 1.35)

    flagged = (F.abs(far("slope")) > spread) | (F.abs(far("residual")) > spread) | (F.abs(far("variety")) > spread) | (far("divergence") > spread) | (F.col("lang") == "?")
    return joined.select("doc_id", "lang", "words", "slope", "residual", "variety", "divergence", "outside", F.coalesce(flagged, F.lit(True)).alias("flagged")).withColumn("spam", F.col("flagged") & (F.col("outside") > half))
