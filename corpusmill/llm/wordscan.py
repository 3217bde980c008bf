"""Vectorised word scanning for Arrow batches.

A *word* is a maximal run of letters and digits, compared in lower case.  The scanner works on
whole batches with numpy (one pass over the code points) instead of one Python call per word, so
a task spends well under a microsecond per word.  Hashes are 64 bits wide and depend on the word's
text only, never on the batch, the partition or the process.
"""

from __future__ import annotations

import numpy as np

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_ALNUM: np.ndarray | None = None
_POWERS = np.ones(1, dtype=np.uint64)


def _alnum_table() -> np.ndarray:
    global _ALNUM
    if _ALNUM is None:
        table = np.zeros(0x110000, dtype=bool)
        for start in range(0, 0x110000, 0x10000):
            if start >= 0x40000:  # planes without letters
                break
            table[start : start + 0x10000] = [chr(c).isalnum() for c in range(start, start + 0x10000)]
        _ALNUM = table
    return _ALNUM


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 64)
        grown = np.full(size, _MULTIPLIER, dtype=np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on an array of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def scan_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in reading order, and the first word's index of each text
    (one entry more than texts; the last is the number of words)."""
    lowered = [t.lower() for t in texts]
    cps = code_points("\n".join(lowered))
    if len(cps) == 0:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    word = _alnum_table()[cps]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & ~before)
    inside = cps[word].astype(np.uint64)
    if len(starts) == 0:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    order = np.cumsum(word) - 1  # index among the word characters
    first = order[starts]
    lengths = np.diff(np.append(first, len(inside)))
    place = np.arange(len(inside)) - np.repeat(first, lengths)
    inside += np.uint64(1)
    inside *= _powers(int(lengths.max()))[place]
    hashes = mix64(np.add.reduceat(inside, first) + lengths.astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in lowered])  # the text's end, behind its line feed
    bounds = np.empty(len(texts) + 1, np.int64)
    bounds[0] = 0
    bounds[1:] = np.searchsorted(starts, ends, side="left")
    return hashes, bounds


def shingle_sets(texts: list[str], width: int = 3) -> list[np.ndarray]:
    """The sorted distinct hashes of ``width`` consecutive words of each text.

    A text with fewer words has one hash, of all its words; a text without words has one hash of
    its characters, so that only an identical text equals it.
    """
    hashes, bounds = scan_words(texts)
    n = len(hashes)
    if n >= width:
        grams = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            grams += hashes[k : n - width + 1 + k] * _powers(width + 1)[k + 1]
        grams = mix64(grams)
    else:
        grams = np.empty(0, np.uint64)
    out = []
    for i, text in enumerate(texts):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= width:
            s = np.sort(grams[a : b - width + 1])
            if len(s) > 1:
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
        elif b > a:
            s = mix64(np.array([np.bitwise_xor.reduce(hashes[a:b] * _powers(width + 1)[: b - a]) + np.uint64(b - a)]))
        else:
            cps = code_points(text).astype(np.uint64)
            total = np.add.reduce((cps + np.uint64(1)) * _powers(len(cps) + 1)[: len(cps)]) if len(cps) else np.uint64(0)
            s = mix64(np.array([total ^ np.uint64(0x5BD1E995)], dtype=np.uint64))
        out.append(s)
    return out
