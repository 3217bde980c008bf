"""Defects of prompt-response pairs.

One pass over the pairs runs the checks that need one pair only (no content, copy of the question,
language, ending) and takes every clause of the response, quotations left out.  Words that belong to
what is talked about are masked: those that prompts use at least half as often, word for word, as
responses do.  What is left of a clause is its opening; openings are clustered by MinHash with
verified similarity, and a cluster that recurs under unrelated prompts is a template.  A template is
a refusal where the judge's labels of its responses mostly say so.  No list of wordings is used.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise, semi_join_keys
from .wordscan import mix64, shingle_sets

# What stands for no content at all, letters and digits only, lower case.
PLACEHOLDERS = frozenset("na none null nil nan tbd todo undefined empty noanswer noresponse noanswergiven nocontent answer response output antwort keineantwort réponse reponse pasderéponse respuesta sinrespuesta leer vide vacío".split())

# Frequent words of the four languages of the collection.
FUNCTION_WORDS = {
    "en": "the a an of is are was this that these and in on at to with every each one when which what why how does do by for its it neither nor without yes never only later as should if while because unlike note we than from safe during has have be not or still after before into instead until most some under our there about",
    "de": "der die das den dem des ein eine einen einem einer und ist sind nicht kein keine wie was wann wird werden welche welcher warum mit auf oder für im in ohne nach unter denn weil jedem jeden jeder ja nein nur bei von zu zur zum als innerhalb weniger trotz wenn sie ich diese dieser aus erst spielt am sich hilfe",
    "fr": "le la les l d est et un une des du de quand quel quelle que qui dans sur pour car sans après avant comment pourquoi oui non seulement au aux en se si il elle ne plus pas par avec ce cette à chaque malgré grâce pendant sous même ou je nous vous",
    "es": "el la los las es y un una unos de del que qué cómo cuándo cuál por porque sin en con para solo tres sí se al más lo su sus este esta o tras durante según antes entre donde no cada muy ya le",
}
_WORDS = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}
_LETTERS = {"de": re.compile("[äöüß]"), "fr": re.compile("[êèàçœùîôûë]"), "es": re.compile("[áíóúñ¿¡]")}

# Names of the languages in the four languages.
LANGUAGE_NAMES = {
    "en": "english englisch anglais inglés ingles",
    "de": "german deutsch allemand alemán aleman",
    "fr": "french französisch franzoesisch français francais francés frances",
    "es": "spanish spanisch espagnol español espanol castellano",
}
_NAMED = {name: lang for lang, names in LANGUAGE_NAMES.items() for name in names.split()}

_QUOTED = re.compile(r"“[^”]*”|„[^“”]*[“”]|«[^»]*»|\"[^\"\n]*\"|(?<!\w)'[^'\n]{6,}?'(?!\w)")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”»)\]']*\s+|\n+")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_MARKUP = re.compile("<[^<>]{0,200}>|[`*_#>~|\u200b-\u200f\u2060\ufeff\u00ad]")
_FENCED = re.compile(r"```.*?(?:```|\Z)", re.S)
_CLOSED = re.compile(r"[.!?…。][\"'”“»)\]*_`]*$")
_CITED = re.compile(r"\[\d+(?:\s*[,;–-]\s*\d+)*\][.\"'”»)]*$")
_ITEM = re.compile(r"\s*(?:[-*•+–]|\(?\d{1,3}[.)])(?:\s+(.*))?$")
_LABELLED = re.compile(r"(?is)^\s*(?:question|frage|pregunta|q)\s*:\s*(.*?)\n\s*(?:answer|antwort|réponse|respuesta|a)\s*:\s*(.*)$")
_PREFIX = re.compile(r"^\W*[^\W\d_][^:\n]{0,30}:\s*(?=\S)")
_ASKED = re.compile(r"[\s(,;.?]*(?:please\s+)?(?:answer|reply|respond|write|bitte|antworte|responde|réponds|répondez)\b[^.?!()]{0,40}[.)]?\s*$", re.I)
_CLAUSE = re.compile(r"[,;:()]\s+|\s[–—-]\s")
HELD = 500_000  # sets that a task remembers between buckets
BLOCK = 1024  # members of a bucket that are compared in one row
CHECK_SCHEMA = "request_id string, stamp timestamp, prompt long, defect string, asked array<string>, clauses array<string>"


def words(text: str) -> list[str]:
    return [w.replace("’", "'") for w in _WORD.findall(text.lower())]


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    bare = re.sub(r"[\W_]+", "", _MARKUP.sub("", answer)).lower()
    return not bare or bare in PLACEHOLDERS


def _trigrams(said: list[str]) -> Counter:
    return Counter(t for w in said for t in (f" {w} "[i : i + 3] for i in range(len(w))))


def is_copy(question: str, answer: str, similar: float = 0.75) -> bool:
    """The answer is the question, once or any number of times over, up to a few letters or a word,
    markup, quotes and a label in front.

    An answer with fewer than 0.4 of its letters in words of the question is none.  Otherwise the
    letter trigrams of the words are compared as multisets (Dice), those of the question as often as
    the answer is longer.  Time is linear in both texts.
    """
    labelled = _LABELLED.match(answer)
    known = frozenset(words(question))
    asked: list[Counter] = []
    for text in dict.fromkeys((labelled.group(2) if labelled else answer, _PREFIX.sub("", answer))):
        w = words(text)
        if sum(len(x) for x in w if x in known) < 0.4 * sum(map(len, w)):
            continue
        said = _trigrams(w)
        n = said.total()
        asked = asked or [_trigrams(words(q)) for q in dict.fromkeys((question, _ASKED.sub("", question)))]
        for q in asked:
            m = q.total()
            if n and m:
                times = max(1, round(n / m))
                common = sum(min(times * k, said[t]) for t, k in q.items())
                if 2 * common >= similar * (n + times * m):
                    return True
    return False


def language_words(text: str) -> dict[str, int]:
    """Words of each language by sentence; a sentence without a clear language counts nowhere."""
    total = dict.fromkeys(_WORDS, 0)
    for sentence in _SENTENCE.split(text):
        w = words(sentence)
        if not w:
            continue
        parts = [p for x in w for p in x.split("'")]
        score = {lang: sum(map(known.__contains__, parts)) for lang, known in _WORDS.items()}
        if not sentence.isascii():
            low = sentence.lower()
            for lang, letters in _LETTERS.items():
                score[lang] += len(letters.findall(low))
        best = max(score, key=score.get)
        if score[best] >= 2 and sum(v == score[best] for v in score.values()) == 1:
            total[best] += len(w)
    return total


def asked_language(question: str) -> set[str]:
    return {_NAMED[w] for w in words(question) if w in _NAMED}


def is_wrong_language(question: str, answer: str) -> bool:
    asked = language_words(question)
    own = max(asked, key=asked.get)
    if not asked[own]:
        return False
    got = language_words(_FENCED.sub(" ", answer))
    told = sum(got.values())
    allowed = {own} | asked_language(question)
    other = sum(n for lang, n in got.items() if lang not in allowed)
    return told > 0 and other > 0.5 * told


def is_truncated(answer: str) -> bool:
    """No end of sentence, list, citation or closed code block at the end.

    Short answers without any sentence (a value, a name, a number) are complete.
    """
    text = answer.rstrip()
    if text.count("```") % 2:
        return True
    last = text.rsplit("\n", 1)[-1]
    item = _ITEM.match(last)
    if item and "\n" in text and not (item.group(1) or "").strip():
        return True  # a list mark without its item
    if text.endswith("```") or _CLOSED.search(text) or _CITED.search(text):
        return False
    if item and "\n" in text:
        w = words(item.group(1) or "")
        return not w or w[-1] in _DANGLING or (item.group(1) or "").rstrip()[-1] in ",;:(-"
    w = words(text)
    if not w or text[-1] in ",;:(-–":
        return bool(w)
    if len(w) <= 3 and (any(c.isdigit() for c in text) or not any(p in known for p in w for known in _WORDS.values())):
        return False  # a value or a name
    return True


_DANGLING = frozenset("the a an of and or to with every each this that one on in at behind for by der die das und oder mit le la les un une et de du el los las y o con".split())


def check_pair(question: str | None, answer: str | None) -> str | None:
    """The defect that one pair alone shows (refusals apart)."""
    if is_empty(answer):
        return "empty"
    question = question or ""
    if is_copy(question, answer):
        return "copies_question"
    if is_wrong_language(question, answer):
        return "wrong_language"
    return "truncated" if is_truncated(answer) else None


def clauses(answer: str) -> list[str]:
    """The words of each different clause of all sentences, quotations left out."""
    text = _QUOTED.sub(" ", answer.replace("’", "'"))
    parts = (" ".join(words(c)) for s in _SENTENCE.split(text) for c in _CLAUSE.split(s))
    return list(dict.fromkeys(p for p in parts if p))


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        defects, asked, said = [], [], []
        for q, a in zip(batch["question"].to_pylist(), batch["answer"].to_pylist()):
            defect = check_pair(q, a)
            defects.append(defect)
            asked.append(words(q or ""))
            said.append(clauses(a) if defect != "empty" and defect != "copies_question" else [])
        lists = [pa.array(x, pa.list_(pa.string())) for x in (asked, said)]
        yield pa.record_batch([batch["request_id"], batch["stamp"], batch["prompt"], pa.array(defects, pa.string()), *lists], names=["request_id", "stamp", "prompt", "defect", "asked", "clauses"])


def check_pairs(df: DataFrame, key: str, question: str, answer: str, stamp: str) -> DataFrame:
    """One row a key (of several deliveries the latest, ties by prompt hash): checks, the words of
    the question and the clauses of the answer.  Rows without a key are left out, a null question is
    an empty one."""
    source = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("request_id"), F.col(stamp).cast("timestamp").alias("stamp"), F.xxhash64(F.lower(F.trim(question))).alias("prompt"), F.col(question).alias("question"), F.col(answer).alias("answer"))
    checked = source.mapInArrow(_check, CHECK_SCHEMA)
    latest = F.max_by(F.struct("prompt", "defect", "asked", "clauses"), F.struct(F.coalesce("stamp", F.timestamp_micros(F.lit(0))), "prompt"))
    return checked.groupBy("request_id").agg(latest.alias("c")).select("request_id", "c.*")


def topic_words(checks: DataFrame, ratio: float = 0.5, floor: float = 1e-6) -> DataFrame:
    """``word``: the words that prompts use at least ``ratio`` times as often as responses do, both
    relative to all their words.

    Words below ``floor`` of the prompts' words are no topic words, so there are at most 1 / floor of
    them, whatever the collection: their shares add up to one at most.
    """
    asked = checks.select(F.explode("asked").alias("word"), F.lit(1).alias("q"), F.lit(0).alias("r"))
    said = checks.select(F.explode("clauses").alias("c")).select(F.explode(F.split("c", " ")).alias("word"), F.lit(0).alias("q"), F.lit(1).alias("r"))
    counted = materialise(asked.unionByName(said).groupBy("word").agg(F.sum("q").alias("q"), F.sum("r").alias("r")), "words")
    total = counted.agg(F.sum("q").alias("nq"), F.sum("r").alias("nr"))
    rated = counted.where("q > 0").crossJoin(F.broadcast(total))
    return rated.where((F.col("q") * F.col("nr") >= ratio * F.col("r") * F.col("nq")) & (F.col("q") >= floor * F.col("nq"))).select("word")


def _mask(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        topics = shared.value
        for batch in batches:
            out = []
            for said in batch["clauses"].to_pylist():
                kept = ([w for w in c.split(" ") if w not in topics] for c in said)
                out.append(list(dict.fromkeys(" ".join(k) for k in kept if len(k) > 1)))
            yield pa.record_batch([batch["request_id"], batch["prompt"], pa.array(out, pa.list_(pa.string()))], names=["request_id", "prompt", "openings"])

    return run


def response_openings(checks: DataFrame) -> DataFrame:
    """``request_id, prompt, opening``: each clause's words outside the topics, if there are two."""
    spark = checks.sparkSession
    topics = frozenset(r["word"] for r in topic_words(checks).collect())  # at most 1 / floor words
    masked = checks.select("request_id", "prompt", "clauses").mapInArrow(_mask(spark.sparkContext.broadcast(topics)), "request_id string, prompt long, openings array<string>")
    return masked.select("request_id", "prompt", F.explode("openings").alias("opening"))


def _signatures(width: int, bands: int, rows: int):
    salts = mix64(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    weights, band = np.arange(1, rows + 1, dtype=np.uint64), np.arange(bands, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch["opening"].to_pylist(), width)
            values = []
            for s in sets:
                mins = mix64(s[None, :] ^ salts[:, None]).min(axis=1).reshape(bands, rows)
                values.append(mix64(np.add.reduce(mins * weights, axis=1) + band).view(np.int64))
            yield pa.record_batch([batch["id"], _lists([s.view(np.int64) for s in sets]), _lists(values)], names=["id", "shingles", "bands"])

    return run


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64)))


def _links(threshold: float):
    """Edges that join the members of each bucket which verified similarities connect.

    Within a bucket only sets that share a word of their prefixes (rarest words of the bucket first)
    can be similar enough; of these, what the task has already connected isn't compared again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        said: dict[int, list] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for batch in batches:
            edges: list[tuple[int, int]] = []
            members = batch["members"]
            ids = members.values.field("id").to_pylist()
            shingles = members.values.field("shingles")
            at, starts, values = members.offsets.to_pylist(), shingles.offsets.to_pylist(), shingles.values.to_numpy()
            for x, i, j in zip(ids, starts, starts[1:]):
                if x not in said:
                    said[x] = values[i:j].tolist()
            for first, last in zip(at, at[1:]):
                bucket = ids[first:last]
                if len({root(x) for x in bucket}) == 1:
                    continue
                often = Counter(w for x in bucket for w in said[x])
                having: dict[int, list[tuple[int, frozenset]]] = {}
                for x in bucket:
                    own = sorted(said[x], key=often.__getitem__)
                    n, words_of = len(own), frozenset(own)
                    for w in own[: n - math.ceil(threshold * n - 1e-9) + 1]:
                        met = having.setdefault(w, [])
                        for y, other in met:
                            if parent[x] != parent[y] and root(x) != root(y):
                                common = len(words_of & other)
                                if common >= threshold * (n + len(other) - common) - 1e-9:
                                    edges.append((x, y))
                                    parent[root(x)] = root(y)
                        met.append((x, words_of))
            yield pa.record_batch([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])
            if len(said) > HELD:
                parent, said = {}, {}

    return run


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node connected with it) of the nodes of ``edges`` (a, b).

    Every round takes the smallest root of the neighbours, then that root's own root, until nothing
    changes.
    """
    both = materialise(edges.unionByName(edges.select(F.col("a").alias("b"), F.col("b").alias("a"))).distinct(), "links")
    roots = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = roots.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        step = materialise(step, "step")
        jumped = step.join(step.select(F.col("node").alias("root"), F.col("root").alias("top")), "root").select("node", F.col("top").alias("root"), "old")
        jumped = materialise(jumped, "roots")
        roots = jumped.select("node", "root")
        if jumped.where("root != old").isEmpty():
            return roots


def cluster_openings(openings: DataFrame, width: int = 1, threshold: float = 0.8, bands: int = 20, rows: int = 6) -> DataFrame:
    """``opening``, ``cluster`` (its smallest opening) of the distinct openings.

    Openings are linked if MinHash puts them in one bucket and their sets of words (``width`` words in
    a shingle) really have the threshold's similarity; links are transitive.  All members of a bucket
    are compared: one with more than ``BLOCK`` is spread over pairs of blocks.
    """
    source = materialise(openings.select("opening").distinct().select(F.xxhash64("opening").alias("id"), "opening"), "distinct")
    signed = materialise(source.mapInArrow(_signatures(width, bands, rows), "id long, shingles array<long>, bands array<long>"), "signed")
    placed = signed.select("id", F.explode("bands").alias("band"))
    large = materialise(placed.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("band", F.ceil(F.col("n") / F.lit(BLOCK)).alias("k")), "large")
    parts = placed
    if not large.isEmpty():
        parts = semi_join_keys(placed, large.select("band"), "band", anti=True)
        mine, other = F.pmod("id", "k"), F.explode(F.sequence(F.lit(0), F.col("k") - 1))
        cells = semi_join_keys(placed, large.select("band"), "band").join(large, "band").select("id", "band", mine.alias("i"), other.alias("j"))
        parts = parts.unionByName(cells.select("id", F.xxhash64("band", F.least("i", "j"), F.greatest("i", "j")).alias("band")))
    buckets = parts.groupBy("band").agg(F.collect_list("id").alias("ids")).where("size(ids) > 1").select(F.array_sort("ids").alias("ids")).distinct()
    members = buckets.select(F.xxhash64("ids").alias("bucket"), F.explode("ids").alias("id")).join(signed.select("id", "shingles"), "id")
    near = members.groupBy("bucket").agg(F.collect_list(F.struct("id", "shingles")).alias("members")).select("members").mapInArrow(_links(threshold), "a long, b long")
    linked = source.join(components(near), F.col("id") == F.col("node")).select("opening", "root")
    names = linked.groupBy("root").agg(F.min("opening").alias("cluster"))
    return source.select("opening").join(linked.join(names, "root").select("opening", "cluster"), "opening", "left").select("opening", F.coalesce("cluster", "opening").alias("cluster"))


def _mostly(refused: Column, judged: Column, share: float) -> Column:
    """The lower end of the one-sigma Wilson interval of refused / judged is at least the share."""
    p = refused / judged
    low = (p + 0.5 / judged - F.sqrt(p * (1 - p) / judged + 0.25 / (judged * judged))) / (1 + 1 / judged)
    return low >= share - 1e-9


def refusal_openings(said: DataFrame, refusal_labels: DataFrame, least_prompts: int = 3, least_share: float = 0.5) -> DataFrame:
    """Openings of the templates that recur under unrelated prompts and decline to answer.

    A template declines if it has at least ``least_prompts`` different prompts and judged responses,
    and the share of these that are labelled refusals is at least ``least_share`` even at the lower
    end of its Wilson interval (3 of 3, 3 of 4, 6 of 9).  Without any label there are none.
    said: request_id, prompt, opening.  refusal_labels: request_id, refused (0 or 1).
    """
    said = materialise(said.join(refusal_labels, "request_id", "left"), "said")
    counted = materialise(said.groupBy("opening").agg(F.count_distinct("prompt").alias("prompts"), F.count("refused").alias("judged"), F.coalesce(F.sum("refused"), F.lit(0)).alias("refused")), "openings")
    clusters = materialise(cluster_openings(counted), "clusters")
    # a prompt or response with several openings of a cluster counts once: the sums are upper bounds
    # and the largest count a lower one, so no template is lost here
    bounds = counted.join(clusters, "opening").groupBy("cluster").agg(F.sum("prompts").alias("prompts"), F.sum("refused").alias("refused"), F.max("judged").alias("judged"))
    likely = bounds.where((F.col("prompts") >= least_prompts) & (F.col("refused") >= least_share * F.greatest(F.col("judged"), F.lit(least_prompts)))).select("cluster")
    kept = materialise(clusters.join(likely, "cluster"), "likely")
    responses = semi_join_keys(said, kept.select("opening"), "opening").join(kept, "opening").groupBy("cluster", "request_id").agg(F.first("prompt").alias("prompt"), F.first("refused").alias("refused"))
    template = responses.groupBy("cluster").agg(F.count_distinct("prompt").alias("prompts"), F.count("refused").alias("judged"), F.coalesce(F.sum("refused"), F.lit(0)).alias("refused"))
    template = template.where((F.col("prompts") >= least_prompts) & (F.col("judged") >= least_prompts) & _mostly(F.col("refused"), F.col("judged"), least_share))
    return kept.join(template, "cluster").select("opening", "cluster", "prompts", "judged", "refused")


def pair_defects(checks: DataFrame, refusal_labels: DataFrame) -> DataFrame:
    """``request_id``, ``defect`` of the defective pairs, one each.

    Order of the tests: empty, copies_question, refusal, wrong_language, truncated.
    """
    checks = materialise(checks, "checks")
    said = materialise(response_openings(checks), "openings_of")
    templates = materialise(refusal_openings(said, refusal_labels).select("opening").distinct(), "templates")
    refusing = semi_join_keys(said, templates, "opening").select("request_id").distinct().withColumn("template", F.lit(True))
    defect = F.when(F.col("defect").isin("empty", "copies_question"), F.col("defect")).when(F.col("template"), F.lit("refusal")).otherwise(F.col("defect"))
    return checks.select("request_id", "defect").join(refusing, "request_id", "left").select("request_id", defect.alias("defect")).where("defect is not null")


def refusal_labels(judged: DataFrame) -> DataFrame:
    """The judge's word on each request: refused 1 or 0; the latest delivery of each key counts.

    Spellings differ in case, blanks and underscores; rows without a label say nothing.
    """
    label = F.regexp_replace(F.lower(F.trim("label")), r"[\s_-]+", "_")
    latest = judged.where("suite_name = 'correct_refusal'").groupBy("request_id", "run_id").agg(F.max_by(label, F.col("created_at")).alias("label"))
    return latest.where("label is not null").groupBy("request_id").agg(F.max(F.col("label").isin("correct_refusal", "unnecessary_refusal").cast("int")).alias("refused"))
