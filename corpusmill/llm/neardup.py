"""Near-duplicate groups by a grouped prefix set-similarity join (exact, no sampling).

Plan, for a threshold ``t`` on the Jaccard similarity of the texts' sets of word shingles:

1. One pass hashes every text's shingles, names its *class* (texts with equal sets are copies) and
   counts all shingles in a frequency sketch of fixed size.  Sketch cells only over-estimate.
2. A second pass sorts each set rarest first by the sketch (any total order that all tasks share
   keeps the join exact) and cuts its prefix.  Documents with identical prefix and size form one
   group.  Shingles whose cell counts one document cannot meet anybody and are not sent.
3. Every document is written once, with its prefix shingles and a parity bitmap of its set.  Shingles
   that the sketch shows to be very frequent are spread over a triangle of blocks.
4. The prefix shingles are hashed to buckets, of a number in proportion to all of them.  A bucket gets
   a document once, with its bitmap and its shingles there.  As a document goes to as many buckets as it
   has prefix shingles once there are many, buckets are filled in *waves*: each reads the documents again,
   shuffles those of its own buckets, and releases its shuffle files before the next one begins.
5. In a bucket, pairs of groups are filtered by size and position, then expanded to their members,
   which the bitmaps filter (the bits in which two bitmaps differ bound the symmetric difference).
   Posting lists that turn out longer than ``block`` are sent on and joined by blocks, too.
6. What is left, nearly only true pairs, is verified on the texts.

Results are classes and pairs of class representatives; copies are never expanded here.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_KEYS, materialise, semi_join_keys, sweep
from .wordscan import mix64, shingle_sets

SCAN_SCHEMA = "id string, rank struct<stamp: string, text_hash: long>, class long, n int, block int, counts binary"
POST_SCHEMA = "bucket int, post binary"
PREFIX_SCHEMA = "prefixes binary"
PAIR_SCHEMA = "class_a long, class_b long, size long, post binary"
POSTINGS_AT_ONCE = 1 << 18
TEXTS_AT_ONCE = 256


@dataclass(frozen=True)
class JoinSpec:
    """width: words in a shingle.  threshold: least Jaccard similarity.  sketch_bits: the sketch has
    two to this power cells of one byte (its broadcast size).  block: documents of one posting list
    that meet in one task.  postings: of one bucket.  wave: the shuffle of one wave of buckets, as a
    multiple of the documents with their prefixes."""

    width: int = 5
    threshold: float = 0.8
    sketch_bits: int = 23
    sketch_blocks: int = 64
    block: int = 2048
    postings: int = 500_000
    wave: float = 2.0


@dataclass
class NearDuplicates:
    """members: id, class.  pairs: class_a < class_b, similarity of two different classes."""

    members: DataFrame
    pairs: DataFrame


def _encode_counts(counts: np.ndarray) -> np.ndarray:
    """One byte a count: exact to 64, then eight steps an octave, rounded up."""
    c = np.maximum(counts, 1).astype(np.float64)
    code = np.where(c <= 64, c, 64 + np.ceil(8 * np.log2(c / 64)))
    return np.where(counts == 0, 0, np.minimum(code, 255)).astype(np.uint8)


def decode_count(code: np.ndarray) -> np.ndarray:
    code = code.astype(np.float64)
    return np.where(code <= 64, code, 64 * np.exp2((code - 64) / 8))


def set_class(s: np.ndarray) -> int:
    """A 64-bit name of a shingle set, the same for equal sets only (up to hash collisions)."""
    h = np.array([np.add.reduce(s)], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h += np.bitwise_xor.reduce(mix64(s))
    return int(mix64(h ^ np.uint64(len(s)))[0].astype(np.int64))


def needed_overlap(n, m, t: float):
    """Least common shingles of sets of n and m shingles whose similarity is at least t."""
    return np.ceil(t / (1 + t) * (n + m) - 1e-9)


def _scan_and_count(spec: JoinSpec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << spec.sketch_bits, np.uint32)
        schema = pa.schema([("id", pa.string()), ("rank", pa.struct([("stamp", pa.string()), ("text_hash", pa.int64())])), ("class", pa.int64()), ("n", pa.int32()), ("block", pa.int32()), ("counts", pa.binary())])
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                sets = shingle_sets(part["text"].to_pylist(), spec.width)
                if sets:
                    cells += np.bincount((np.concatenate(sets) >> np.uint64(64 - spec.sketch_bits)).astype(np.int64), minlength=len(cells)).astype(np.uint32) if sum(map(len, sets)) > len(cells) // 8 else _sparse_counts(cells, sets, spec)
                k = part.num_rows
                yield pa.record_batch([part["id"], part["rank"], pa.array([set_class(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], schema=schema)
        blocks = cells.reshape(spec.sketch_blocks, -1)
        for b, block in enumerate(blocks):
            at = np.flatnonzero(block)
            if len(at):
                coded = pa.compress(np.diff(at, prepend=0).astype(np.uint32).tobytes() + block[at].tobytes(), codec="zstd", asbytes=True)
                yield pa.record_batch([pa.nulls(1, pa.string()), pa.nulls(1, schema.field("rank").type), pa.nulls(1, pa.int64()), pa.array([len(at)], pa.int32()), pa.array([b], pa.int32()), pa.array([coded], pa.binary())], schema=schema)

    return run


def _sparse_counts(cells: np.ndarray, sets: list[np.ndarray], spec: JoinSpec) -> int:
    at, counts = np.unique((np.concatenate(sets) >> np.uint64(64 - spec.sketch_bits)).astype(np.int64), return_counts=True)
    cells[at] += counts.astype(np.uint32)
    return np.uint32(0)


def _merge_counts(spec: JoinSpec):
    """Add the tasks' counts block by block; a stream, whatever the number of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, n, coded in zip(batch["block"].to_pylist(), batch["n"].to_pylist(), batch["counts"].to_pylist()):
                raw = np.frombuffer(pa.decompress(coded, 8 * n, codec="zstd", asbytes=True), np.uint32)
                total = sums.setdefault(b, np.zeros((1 << spec.sketch_bits) // spec.sketch_blocks, np.uint64))
                total[np.cumsum(raw[:n])] += raw[n:]
        for b, total in sums.items():
            coded = pa.compress(_encode_counts(total).tobytes(), codec="zstd", asbytes=True)
            yield pa.record_batch([pa.array([b], pa.int32()), pa.array([coded], pa.binary())], names=["block", "counts"])

    return run


def map_words(n: np.ndarray) -> np.ndarray:
    """64-bit words of the bitmap of a set of n shingles."""
    return 1 << np.clip(np.ceil(np.log2(2 * np.maximum(n, 1))).astype(np.int64) - 6, 0, 9)


def _bitmap(s: np.ndarray) -> np.ndarray:
    """Parity bitmap with about two bits a shingle, from 64 to 2**15 bits."""
    bits = 64 * int(map_words(np.array([len(s)]))[0])
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _prefixes(spec: JoinSpec, sketch, load: float):
    """Documents with their prefix shingles, whatever the buckets.  load: the mean count of a sketch cell; what a cell counts beyond a few times of it is due to
    one frequent shingle."""
    t = spec.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(sketch.value, np.uint8)
        seen: dict[int, None] = {}
        held = _Held()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                for s in shingle_sets(batch.slice(at, TEXTS_AT_ONCE)["text"].to_pylist(), spec.width):
                    name = set_class(s)
                    if name in seen:  # copies within a task are sent once
                        continue
                    if len(seen) >= 1 << 18:
                        seen.clear()
                    seen[name] = None
                    n = len(s)
                    code = table[(s >> np.uint64(64 - spec.sketch_bits)).astype(np.int64)]
                    prefix = prefix_length(n, t)
                    order = np.argsort(code, kind="stable")[:prefix]  # s is sorted, so ties go by hash
                    token, freq = s[order], code[order]
                    group = int(mix64(np.array([np.add.reduce(token * np.arange(1, prefix + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(n)]))[0] >> np.uint64(32))
                    place = np.flatnonzero(freq > 1)
                    if not len(place):
                        continue
                    token, freq = token[place], freq[place]
                    blocks = np.ceil((decode_count(freq) - 4 * load) / spec.block).astype(np.int64)
                    if (blocks > 1).any():
                        token, place = spread(token, place, np.maximum(blocks, 1), name)
                    held.add(name, group, n, token, place, _bitmap(s))
                if held.size > POSTINGS_AT_ONCE:
                    yield _stored(*held.take())
        if held.size:
            yield _stored(*held.take())

    return run


def prefix_length(n, t: float):
    return n - np.ceil(t * n - 1e-9).astype(np.int64) + 1


class _Held:
    """Documents with shingles that wait to be handed on."""

    def __init__(self) -> None:
        self.docs: list[tuple] = []
        self.size = 0

    def add(self, name: int, group: int, n: int, token: np.ndarray, place: np.ndarray, bitmap: np.ndarray) -> None:
        self.docs.append((name, group, n, token, place, bitmap))
        self.size += len(token)

    def take(self) -> tuple[np.ndarray, ...]:
        """name, group, size, number of postings, token, place, words of the bitmaps."""
        names, groups, sizes, tokens, places, maps = zip(*self.docs)
        self.docs, self.size = [], 0
        return np.array(names, np.int64), np.array(groups, np.uint32), np.array(sizes, np.uint32), np.array([len(t) for t in tokens], np.uint32), np.concatenate(tokens), np.concatenate(places).astype(np.uint32), np.concatenate(maps)


#: Bits of a shingle's hash that choose its bucket, and with the low 32 tell it from others there.
TOKEN_BITS = 40


def _stored(name, group, size, count, token, place, words) -> pa.RecordBatch:
    """One record of documents: their number and that of the postings, the documents, the shingles'
    low 32 bits and the eight above, the steps from place to place, and the bitmaps."""
    steps = np.diff(place.astype(np.int32), prepend=np.int32(0))
    high = (token >> np.uint64(32)).astype(np.uint8)
    raw = b"".join(x.tobytes() for x in (np.array([len(name), len(token)], np.uint32), name, group, size, count, token.astype(np.uint32), steps, words, high))
    return pa.record_batch([pa.array([raw], pa.binary())], names=["prefixes"])


def _restored(raw: bytes) -> tuple[np.ndarray, ...]:
    """What _stored was given, of the shingles TOKEN_BITS bits."""
    d, p = np.frombuffer(raw, np.uint32, 2).tolist()
    group, size, count = (np.frombuffer(raw, np.uint32, d, 8 + 8 * d + 4 * d * k) for k in range(3))
    at = 8 + 20 * d
    token = np.frombuffer(raw, np.uint32, p, at).astype(np.uint64) | np.frombuffer(raw, np.uint8, p, len(raw) - p).astype(np.uint64) << np.uint64(32)
    place = np.cumsum(np.frombuffer(raw, np.int32, p, at + 4 * p), dtype=np.int32).astype(np.uint32)
    return np.frombuffer(raw, np.int64, d, 8), group, size, count, token, place, np.frombuffer(raw, np.uint64, (len(raw) - at - 9 * p) // 8, at + 8 * p)


def _gather(words: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The words from each ``at`` on, of each one's size, one after the other."""
    ends = np.cumsum(sizes)
    return words[np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - (ends - sizes), sizes)]


def _packed(docs: tuple[np.ndarray, ...], buckets: int, waves: int = 1, wave: int = 0) -> pa.RecordBatch | None:
    """One record for each bucket of the wave that the documents have shingles in.

    A record holds the numbers of documents and postings, the documents (name, group, size, number of
    postings), the postings (the shingle's low 32 bits and its place in the prefix) and the bitmaps.
    """
    name, group, size, count, token, place, words = docs
    bucket = (mix64(token & np.uint64((1 << TOKEN_BITS) - 1)) % np.uint64(buckets)).astype(np.int32)
    doc = np.repeat(np.arange(len(name)), count)
    if waves > 1:
        mine = np.flatnonzero(bucket % waves == wave)
        bucket, doc, token, place = bucket[mine] // waves, doc[mine], token[mine], place[mine]
    if not len(bucket):
        return None
    by = np.argsort(bucket, kind="stable")  # the documents are in order already
    bucket, doc, token, place = bucket[by], doc[by], (token[by] & np.uint64(0xFFFFFFFF)).astype(np.uint32), place[by]
    starts = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1])))
    edges = np.append(starts, len(bucket))
    here, of = np.diff(edges).astype(np.uint32), doc[starts]
    sizes = map_words(size.astype(np.int64))
    at = np.cumsum(sizes) - sizes
    maps, ends = _gather(words, at[of], sizes[of]), np.append(0, np.cumsum(sizes[of]))
    first = np.flatnonzero(np.append(True, bucket[starts][1:] != bucket[starts][:-1])).tolist()
    names, groups, all_sizes = name[of], group[of], size[of]
    posts = []
    for a, b in zip(first, [*first[1:], len(starts)]):
        x, y = edges[a], edges[b]
        posts.append(b"".join([np.array([b - a, y - x], np.uint32).tobytes(), names[a:b].tobytes(), groups[a:b].tobytes(), all_sizes[a:b].tobytes(), here[a:b].tobytes(), token[x:y].tobytes(), place[x:y].tobytes(), maps[ends[a] : ends[b]].tobytes()]))
    return pa.record_batch([pa.array(bucket[starts[first]], pa.int32()), pa.array(posts, pa.binary())], names=["bucket", "post"])


def _postings(spec: JoinSpec, sketch, buckets: int, load: float):
    """The postings of all buckets, straight from the texts."""
    prefixes, send = _prefixes(spec, sketch, load), _wave(buckets)
    return lambda batches: send(prefixes(batches))


def _wave(buckets: int, waves: int = 1, wave: int = 0):
    """The postings of one wave's buckets (those with this remainder), numbered from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch["prefixes"]:
                out = _packed(_restored(raw.as_py()), buckets, waves, wave)
                if out is not None:
                    yield out

    return run


def _unpack(post: bytes) -> tuple[np.ndarray, ...]:
    """name, group, size, number of postings, token, place, words of the bitmaps."""
    d, p = np.frombuffer(post, np.uint32, 2).tolist()
    group, size, count = (np.frombuffer(post, np.uint32, d, 8 + 8 * d + 4 * d * k) for k in range(3))
    token, place = (np.frombuffer(post, np.uint32, p, 8 + 20 * d + 4 * p * k) for k in range(2))
    return np.frombuffer(post, np.int64, d, 8), group, size, count, token, place, np.frombuffer(post, np.uint64, -1, 8 + 20 * d + 8 * p)


def spread(token: np.ndarray, place: np.ndarray, blocks: np.ndarray, name: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles go to all cells of the document's row and column of their triangle of blocks,
    under a hash of their own each; others stay."""
    tokens, places = [token[blocks == 1]], [place[blocks == 1]]
    for i in np.flatnonzero(blocks > 1):
        k = int(blocks[i])
        mine, other = (name & 0x7FFFFFFF) % k, np.arange(k)
        cell = np.minimum(other, mine) * k + np.maximum(other, mine)
        tokens.append(mix64(token[i] + mix64(cell.astype(np.uint64))))
        places.append(np.full(k, place[i]))
    return np.concatenate(tokens), np.concatenate(places)


def _divide(spec: JoinSpec, buckets: int):
    """Long posting lists, whose length is known now, over the triangles of their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            for size, post in zip(batch["size"].to_pylist(), batch["post"].to_pylist()):
                name, group, n, _, token, place, maps = _unpack(post)
                ends = np.cumsum(map_words(n.astype(np.int64)))
                k = np.array([-(-size // spec.block)])
                for i in range(len(name)):
                    t, p = spread(token[i : i + 1].astype(np.uint64), place[i : i + 1], k, int(name[i]))
                    held.add(int(name[i]), int(group[i]), int(n[i]), t, p, maps[ends[i] - map_words(n[i : i + 1].astype(np.int64))[0] : ends[i]])
                    if held.size > POSTINGS_AT_ONCE:
                        yield _packed(held.take(), buckets)
        if held.size:
            yield _packed(held.take(), buckets)

    return run


class _Bitmaps:
    """Bitmaps of several sizes; a pair is compared at the smaller one's size (the larger is folded)."""

    def __init__(self, words: np.ndarray, at: np.ndarray, size: np.ndarray):
        self.size = size
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.own = {int(s): (pick := np.flatnonzero(size == s), words[at[pick][:, None] + np.arange(s)]) for s in np.unique(size)}

    def level(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The bitmaps of at least this size, folded to it, and where each one's is."""
        if size not in self.at:
            picks, rows = [], []
            for s, (pick, words) in self.own.items():
                if s >= size:
                    while words.shape[1] > size:
                        half = words.shape[1] // 2
                        words = words[:, :half] ^ words[:, half:]
                    picks.append(pick)
                    rows.append(words)
            place = np.zeros(len(self.size), np.int32)
            place[np.concatenate(picks)] = np.arange(sum(map(len, picks)), dtype=np.int32)
            self.at[size] = np.concatenate(rows), place
        return self.at[size]

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        size = np.minimum(self.size[a], self.size[b])
        for s in np.unique(size):
            pick = np.flatnonzero(size == s)
            rows, row = self.level(int(s))
            for at in range(0, len(pick), 1 << 16):
                p = pick[at : at + (1 << 16)]
                out[p] = np.bitwise_count(rows[row[a[p]]] ^ rows[row[b[p]]]).sum(axis=1)
        return out


def _bucket_join(spec: JoinSpec, divide: bool):
    """Pairs of classes that meet in a bucket.  divide: lists above ``block`` are sent on instead."""
    t = spec.threshold
    schema = pa.schema([("class_a", pa.int64()), ("class_b", pa.int64()), ("size", pa.int64()), ("post", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posts = [_unpack(post) for batch in batches for post in batch["post"].to_pylist()]
        if not posts:
            return
        name, group, n_of, count, token, place, words = (np.concatenate(x) for x in zip(*posts))
        del posts
        sizes = map_words(n_of.astype(np.int64))
        at = np.cumsum(sizes) - sizes
        # a class that several tasks have sent is one document
        names, leader, same = np.unique(name, return_index=True, return_inverse=True)
        owner = np.repeat(same, count)
        size_of = n_of[leader].astype(np.int64)
        bitmaps = _Bitmaps(words, at[leader], sizes[leader])
        # groups: documents with the same prefix and size; each has one posting a shingle
        groups, group_of = np.unique(group[leader].astype(np.uint64) << np.uint64(32) | size_of.astype(np.uint64), return_inverse=True)
        members = np.argsort(group_of, kind="stable")
        starts = np.searchsorted(group_of[members], np.arange(len(groups) + 1))
        by = np.lexsort((owner, group_of[owner], size_of[owner], token))
        tok, own, place = token[by], owner[by], place[by].astype(np.int64)
        twice = np.append(False, (tok[1:] == tok[:-1]) & (own[1:] == own[:-1]))
        tok, own, place = tok[~twice], own[~twice], place[~twice]
        unit = group_of[own]
        once = np.append(True, (tok[1:] != tok[:-1]) | (unit[1:] != unit[:-1]))[: len(tok)]
        if divide:
            first = np.flatnonzero(np.append(True, tok[1:] != tok[:-1])[: len(tok)])
            length = np.diff(np.append(first, len(tok)))
            for a, n in zip(first[length > spec.block].tolist(), length[length > spec.block].tolist()):
                for i in range(a, a + n, spec.block):
                    d = own[i : min(i + spec.block, a + n)]
                    k = len(d)
                    post = b"".join([np.array([k, k], np.uint32).tobytes(), names[d].tobytes(), group[leader][d].tobytes(), n_of[leader][d].tobytes(), np.ones(k, np.uint32).tobytes(), tok[i : i + k].tobytes(), place[i : i + k].astype(np.uint32).tobytes(), _gather(words, at[leader[d]], sizes[leader[d]]).tobytes()])
                    yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([n], pa.int64()), pa.array([post], pa.binary())], schema=schema)
            once &= np.repeat(length <= spec.block, length)
        tok, unit, place = tok[once], unit[once], place[once]
        size = (groups & np.uint64(0xFFFFFFFF)).astype(np.int64)[unit]
        found: list[np.ndarray] = []
        held = 0

        def expand(codes: np.ndarray) -> Iterator[np.ndarray]:
            """Pairs of members of the pairs of groups that their bitmaps let pass."""
            ga, gb = codes // len(groups), codes % len(groups)
            na, nb = starts[ga + 1] - starts[ga], starts[gb + 1] - starts[gb]
            count = na * nb
            for at in _runs(count, 1 << 20):
                c = count[at]
                which = np.repeat(np.arange(len(c)), c)
                k = np.arange(len(which)) - np.repeat(np.cumsum(c) - c, c)
                i = members[starts[ga[at]][which] + k // nb[at][which]]
                j = members[starts[gb[at]][which] + k % nb[at][which]]
                ok = (i != j) & ~((ga[at][which] == gb[at][which]) & (i > j))
                i, j = i[ok], j[ok]
                n, m = size_of[i], size_of[j]
                ok = bitmaps.distance(i, j) <= n + m - 2 * needed_overlap(n, m, t)
                a, b = names[i[ok]], names[j[ok]]
                yield np.stack([np.minimum(a, b), np.maximum(a, b)], 1)

        done = np.empty(0, np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal done, held
            if found:
                codes = np.setdiff1d(np.concatenate(found), done)
                done = np.union1d(done, codes) if len(done) < 1 << 24 else codes
                found.clear()
                held = 0
                for pairs in expand(codes):
                    if len(pairs):
                        k = len(pairs)
                        yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())], schema=schema)

        # a group's own members are candidates; where all its lists are sent on, the blocks bring them
        several = np.flatnonzero(np.diff(starts) > 1)
        several = several[np.isin(several, unit)]
        if len(several):
            found.append(several.astype(np.int64) * len(groups) + several)
        step = 1
        active = np.arange(len(tok))
        while True:
            active = active[active + step < len(tok)]
            active = active[tok[active] == tok[active + step]]
            if not len(active):
                break
            i, j = active, active + step
            n, m = size[i], size[j]
            keep = n >= t * m - 1e-9  # sorted by size: j is the larger; farther ones are larger still
            active = active[keep]
            i, j, n, m = i[keep], j[keep], n[keep], m[keep]
            need = needed_overlap(n, m, t)
            p, q = place[i], place[j]
            ok = (p <= n - need) & (q <= m - need) & (np.minimum(p, q) + np.minimum(n - p, m - q) >= need)
            a, b = unit[i[ok]].astype(np.int64), unit[j[ok]].astype(np.int64)
            codes = np.unique(np.minimum(a, b) * len(groups) + np.maximum(a, b))
            found.append(codes)
            held += len(codes)
            if held > 1 << 21:
                yield from flush()
            step += 1
        yield from flush()

    return run


def _runs(count: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of consecutive entries that add up to about ``most``."""
    total = np.cumsum(count)
    at = 0
    while at < len(count):
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
        yield slice(at, end)
        at = end


def _verify(spec: JoinSpec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                left, right = part["text_a"].to_pylist(), part["text_b"].to_pylist()
                texts = list(dict.fromkeys(left + right))
                sets = dict(zip(texts, shingle_sets(texts, spec.width)))
                common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right)], np.float64)
                either = np.array([len(sets[a]) + len(sets[b]) for a, b in zip(left, right)], np.float64) - common
                ok = pa.array(common >= spec.threshold * either - 1e-9)
                out = pa.record_batch([part["class_a"], part["class_b"], pa.array(common / np.maximum(either, 1))], names=["class_a", "class_b", "similarity"])
                yield out.filter(ok)

    return run


def near_duplicates(df: DataFrame, id_col: str, text_col: str, stamp_col=None, spec: JoinSpec = JoinSpec()) -> NearDuplicates:
    """All pairs of different texts whose shingle sets have at least the threshold's similarity.

    A key delivered several times counts once: the delivery with the latest ``stamp_col`` (ties:
    the larger text hash) holds.  Rows without a key or text take no part.  A text shorter than a
    shingle is the shingle of all its words; texts without any word equal only identical ones.
    Other columns of ``df`` are ignored, whatever their names.
    """
    spark = df.sparkSession
    stamp = F.lit(None).cast("string") if stamp_col is None else F.coalesce((stamp_col if not isinstance(stamp_col, str) else F.col(stamp_col)).cast("string"), F.lit(""))
    text = F.col(text_col)
    base = df.select(F.col(id_col).cast("string").alias("id"), F.struct(stamp.alias("stamp"), F.xxhash64(text).alias("text_hash")).alias("rank"), text.alias("text")).where("id is not null and text is not null")
    scanned = materialise(base.mapInArrow(_scan_and_count(spec), SCAN_SCHEMA), "scan", lean=True)
    docs = scanned.where("block is null")
    members = docs.groupBy("id").agg(F.max_by(F.struct("class", "rank"), "rank").alias("m")).select("id", "m.class", "m.rank")
    coded = scanned.where("block is not null").select("block", "n", "counts").repartition(min(spec.sketch_blocks, 16), "block").mapInArrow(_merge_counts(spec), "block int, counts binary")
    coded = materialise(coded, "sketch", lean=True)
    cell_count = (1 << spec.sketch_bits) // spec.sketch_blocks
    sketch = bytearray(1 << spec.sketch_bits)
    for row in coded.collect():  # sketch_blocks rows, whatever the data
        sketch[row["block"] * cell_count : (row["block"] + 1) * cell_count] = pa.decompress(row["counts"], cell_count, codec="zstd", asbytes=True)
    shared = spark.sparkContext.broadcast(bytes(sketch))
    n = F.col("n")
    prefix = n - F.ceil(n * spec.threshold - 1e-9) + 1
    words = F.lit(8) * F.pow(F.lit(2), F.greatest(F.lit(0), F.least(F.lit(9), F.ceil(F.log2(2 * F.greatest(n, F.lit(1)))) - 6)))
    total, prefixes = docs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(prefix), F.lit(0))).first()
    buckets = max(8, -(-int(prefixes) // spec.postings))
    # bytes that the buckets get, where each prefix shingle falls into any of them, and bytes of the documents
    sent, stored = docs.agg(F.sum((20 + words) * buckets * (1 - F.pow(F.lit(1 - 1 / buckets), prefix)) + 8 * prefix), F.sum(20 + words + 5 * prefix)).first()
    waves = 1 if buckets <= 8 else max(1, int(np.ceil(sent / stored / spec.wave)))
    each = max(8, -(-buckets // waves))
    load = total / (1 << spec.sketch_bits)
    join = _bucket_join(spec, True)
    parts = []
    if waves == 1:
        posts = base.select("text").mapInArrow(_postings(spec, shared, each, load), POST_SCHEMA)
        parts.append(materialise(posts.repartitionById(each, F.col("bucket")).mapInArrow(join, PAIR_SCHEMA), "met", lean=True))
    else:
        kept = f"prefixes-{uuid.uuid4().hex}"
        held = materialise(base.select("text").mapInArrow(_prefixes(spec, shared, load), PREFIX_SCHEMA), kept, lean=True)
        for wave in range(waves):
            posts = held.mapInArrow(_wave(each * waves, waves, wave), POST_SCHEMA)
            parts.append(materialise(posts.repartitionById(each, F.col("bucket")).mapInArrow(join, PAIR_SCHEMA), "met", lean=True))
        sweep(spark, kept)
    met = parts[0]
    for p in parts[1:]:
        met = met.unionByName(p)
    pairs = met.where("post is null").select("class_a", "class_b")
    long_ = met.where("post is not null").select("size", "post")
    length = long_.agg(F.sum(F.least("size", F.lit(spec.block)) * F.ceil(F.col("size") / F.lit(spec.block)))).first()[0]
    if length:
        more = max(8, -(-int(length) // spec.postings))
        divided = long_.mapInArrow(_divide(spec, more), POST_SCHEMA).repartitionById(more, F.col("bucket")).mapInArrow(_bucket_join(spec, False), PAIR_SCHEMA)
        pairs = pairs.unionByName(divided.select("class_a", "class_b"))
    candidates = materialise(pairs.distinct(), "candidates", lean=True)
    speaker = docs.groupBy("class").agg(F.max_by(F.struct("id", "rank"), F.struct("rank", "id")).alias("s")).select("class", "s.id", "s.rank")
    named = candidates.select(F.explode(F.array("class_a", "class_b")).alias("class")).distinct()
    speakers = materialise(speaker.join(named, "class"), "speakers", lean=True)
    texts = semi_join_keys(base, speakers.select("id").distinct(), "id").join(speakers.hint("merge"), ["id", "rank"]).groupBy("class").agg(F.max("text").alias("text"))
    texts = materialise(texts, "texts", lean=True)
    a, b = texts.select(F.col("class").alias("class_a"), F.col("text").alias("text_a")), texts.select(F.col("class").alias("class_b"), F.col("text").alias("text_b"))
    verified = candidates.join(a, "class_a").join(b, "class_b").mapInArrow(_verify(spec), "class_a long, class_b long, similarity double")
    return NearDuplicates(members.select("id", "class"), verified)


def expand_pairs(found: NearDuplicates, block: int = 4096) -> DataFrame:
    """Pairs ``id_a < id_b`` of all members: copies of one class, and members of similar classes.

    A class with more than ``block`` members is divided into blocks; each pair of blocks is a join key
    of its own, so no task holds more than one pair of blocks of a class.
    """
    members = materialise(found.members, "members", lean=True)
    large = materialise(members.groupBy("class").agg(F.count("*").alias("n")).where(F.col("n") > block).select("class", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("k")), "large", lean=True)
    few = large.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    m = members.join(F.broadcast(large) if few else large, "class", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    m = m.select("id", "class", "k", F.pmod(F.xxhash64("id"), "k").cast("int").alias("part"))
    x = m.select(F.col("id").alias("x"), F.col("class").alias("class_a"), F.col("k").alias("k_a"), F.col("part").alias("i"))
    y = m.select(F.col("id").alias("y"), F.col("class").alias("class_b"), F.col("k").alias("k_b"), F.col("part").alias("j"))
    # copies: each member meets all blocks of its class
    each = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k_a") - 1)))
    copies = each.join(y, (F.col("class_a") == F.col("class_b")) & (F.col("other") == F.col("j")) & (F.col("x") < F.col("y"))).select("x", "y")
    # similar classes: a row for each pair of blocks
    sizes = m.select("class", "k").distinct()
    cells = found.pairs.select("class_a", "class_b").join(sizes.select(F.col("class").alias("class_a"), F.col("k").alias("ka")), "class_a").join(sizes.select(F.col("class").alias("class_b"), F.col("k").alias("kb")), "class_b")
    cells = cells.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ka") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("kb") - 1))).select("class_a", "class_b", "i", "j")
    near = cells.join(x.select("x", "class_a", "i"), ["class_a", "i"]).join(y.select("y", "class_b", "j"), ["class_b", "j"]).select("x", "y")
    return copies.unionByName(near).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
