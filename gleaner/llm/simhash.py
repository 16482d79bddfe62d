"""SimHash near-duplicates by anchor-point covering.

Fingerprints are linked if at most DISTANCE of their 64 bits differ.  The
anchors are the code words of a covering code: blocks of the bits, each with a
perfect code (two binary Golay codes of 23 bits; for very many fingerprints also
a Hamming code of 15), the other bits only being compared.  If x and y are near,
a point between them has at most half the threshold from each, and its anchor
lies within the covering radius of that point; so both are copied to each
anchor within covering radius plus half the threshold, and meet there.  What
meets at an anchor is compared exactly, and only a forest of the links is kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, only, stage, strings, u64, worker_cache
from .components import Forest, name_components

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Generator polynomial of the binary Golay code of length 23.
GOLAY = 0b110001110101
#: Shingles of a text whose bits are in memory at once.
AT_ONCE = 1 << 16
#: From so many distinct fingerprints on, a third block joins the code.
THIRD_FROM = 1 << 24
#: Larger groups at an anchor are searched by growing components, not by pairs.
PAIRS_UP_TO = 64


def shingle_blocks(text: str, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """64 bits of every shingle in text order, at most AT_ONCE at a time; a shorter text is one shingle, a text without words none."""
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= shingle:
        yield np.array([digest(joined, SEED)], np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    del words
    starts = np.r_[0, ends[: n - shingle] + 1]
    ends = ends[shingle - 1 :]
    for k in range(0, len(starts), AT_ONCE):
        i, j = starts[k : k + AT_ONCE].tolist(), ends[k : k + AT_ONCE].tolist()
        yield np.array([digest(joined[x:y], SEED) for x, y in zip(i, j, strict=True)], np.uint64)


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """64 bits of every shingle in text order."""
    return np.concatenate([np.empty(0, np.uint64), *shingle_blocks(text, shingle)])


def majority(blocks: Iterable[np.ndarray]) -> int:
    """64 bits, each set if it is set in over half of the hashes; 0 for none."""
    total, n = np.zeros(64, np.int64), 0
    for h in blocks:
        bits = np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64)
        whole = len(bits) // 255 * 255
        total += bits[whole:].sum(0, dtype=np.int64)
        if whole:
            total += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big") if n else 0


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64 bits; 0 for a text without words.  Very long texts are taken AT_ONCE shingles at a time."""
    return majority(shingle_blocks(text, shingle))


class Block:
    """A perfect binary code: what error vectors lead from a word to the code words near it."""

    def __init__(self, columns: list[int], checks: int, radius: int, shift: int, spare: int) -> None:
        """columns: syndrome of each bit.  spare: levels beyond the nearest code word."""
        self.n, self.shift = len(columns), shift
        by: list[list[list[int]]] = [[[] for _ in range(1 << checks)] for _ in range(spare + 1)]
        for w in range(radius + spare + 1):
            for at in combinations(range(self.n), w):
                e = s = 0
                for i in at:
                    e |= 1 << i
                    s ^= columns[i]
                by[max(0, w - radius)][s].append(e)
        #: level -> syndrome -> error vectors, filled up with -1; level 0 is the nearest code word.
        self.level = [np.array([x + [-1] * (max(map(len, rows)) - len(x)) for x in rows], np.int64) for rows in by]
        low, high = self.n // 2, self.n - self.n // 2
        self.half, self.low = low, self._table(columns[:low])
        self.high = self._table(columns[low:])
        assert len(self.high) == 1 << high

    @staticmethod
    def _table(columns: list[int]) -> np.ndarray:
        t = np.zeros(1, np.int64)
        for c in columns:
            t = np.concatenate([t, t ^ c])
        return t

    def near(self, fps: np.ndarray) -> list[np.ndarray]:
        """For each level, the code words (rows x candidates, -1: none)."""
        w = (fps >> np.uint64(self.shift)).astype(np.int64) & ((1 << self.n) - 1)
        s = self.low[w & ((1 << self.half) - 1)] ^ self.high[w >> self.half]
        return [np.where(e[s] < 0, -1, e[s] ^ w[:, None]) for e in self.level]


def code(third: bool, distance: int = DISTANCE) -> list[Block]:
    cache = worker_cache()
    if (key := ("code", third, distance)) not in cache:
        r, golay = 1, []
        for _ in range(23):
            golay.append(r)
            r <<= 1
            if r >> 11:
                r ^= GOLAY
        spare = -(-distance // 2)
        cache[key] = [Block(golay, 11, 3, 0, spare), Block(golay, 11, 3, 23, spare), *([Block(list(range(1, 16)), 4, 1, 46, spare)] * third)]
    return cache[key]


def anchors(fps: np.ndarray, blocks: list[Block], spare: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in fps, anchor) of every copy: code words whose levels sum to at most spare."""
    near = [b.near(fps) for b in blocks]
    rows, keys = [], []
    for levels in product(range(spare + 1), repeat=len(blocks)):
        if sum(levels) > spare:
            continue
        key, ok = np.zeros((len(fps), 1), np.int64), np.ones((len(fps), 1), bool)
        for b, n, lv in zip(blocks, near, levels, strict=True):
            k = n[lv]
            key = ((key << b.n)[:, :, None] | np.maximum(k, 0)[:, None, :]).reshape(len(fps), -1)
            ok = (ok[:, :, None] & (k >= 0)[:, None, :]).reshape(len(fps), -1)
        at = np.nonzero(ok)
        rows.append(at[0])
        keys.append(key[at])
    return np.concatenate(rows), np.concatenate(keys)


def grow(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of a large group; what is reached leaves the set that is searched."""
    a, b, rest = [], [], fps
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            hit = np.bitwise_count(rest ^ x) <= distance
            if hit.any():
                got, rest = rest[hit], rest[~hit]
                a.append(np.full(len(got), x))
                b.append(got)
                front += list(got)
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def meet(batches: Iterator[tuple[np.ndarray, np.ndarray]], distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """From (anchor, fingerprint) sorted by anchor: links that span what is near at each anchor."""
    held_k, held_f = [], []

    def links(k: np.ndarray, f: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        size = np.diff(np.r_[first, len(k)])
        for s, n in zip(first[size > PAIRS_UP_TO], size[size > PAIRS_UP_TO], strict=True):
            yield grow(f[s : s + n], distance)
        left = np.repeat(np.where(size > PAIRS_UP_TO, 1, size), size) - (np.arange(len(k)) - np.repeat(first, size))  # rows of the group from here on
        at = np.flatnonzero((left > 1) & (np.repeat(size, size) <= PAIRS_UP_TO))
        lag = 1
        while len(at):
            hit = np.bitwise_count(f[at] ^ f[at + lag]) <= distance
            yield f[at[hit]], f[at[hit] + lag]
            lag += 1
            at = at[left[at] > lag]

    for k, f in batches:
        if not len(k):
            continue
        held_k.append(k)
        held_f.append(f)
        if k[-1] == held_k[0][0] and k[0] == k[-1]:
            continue  # one group so far
        k, f = np.concatenate(held_k), np.concatenate(held_f)
        cut = int(np.searchsorted(k, k[-1], "left"))
        yield from links(k[:cut], f[:cut])
        held_k, held_f = [k[cut:]], [f[cut:]]
    if held_k:
        yield from links(np.concatenate(held_k), np.concatenate(held_f))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every whole text; null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), u64(np.array([fingerprint(t, shingle) for t in strings(b.column(1))], np.uint64))], ["doc_id", "fp"])

    return arrow_map(only(docs, doc_id="long", text="string"), run, "doc_id long, fp long")


def near_links(fps: DataFrame, n: int, distance: int = DISTANCE) -> DataFrame:
    """a, b: links that span the components of the distinct fingerprints fp within `distance` bits.  n: how many there are."""
    third, spare = n >= THIRD_FROM, -(-distance // 2)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = code(third, distance)
        for b in batches:
            f = b.column(0).to_numpy().view(np.uint64)
            rows, keys = anchors(f, blocks, spare)
            yield pa.RecordBatch.from_arrays([pa.array(keys), u64(f[rows])], ["anchor", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for a, b in meet(((b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)) for b in batches), distance):
            forest.link(a.view(np.int64), b.view(np.int64))
        yield forest.links()

    spark = fps.sparkSession
    copies = arrow_map(fps.select("fp"), copy, "anchor long, fp long", "code")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 50_000)
    return arrow_map(copies.repartition(parts, "anchor").sortWithinPartitions("anchor", "fp"), compare, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, root, component_id for every row of docs.  (Links of a stated resemblance: resemblance.near_duplicates.)

    component_id: the smallest doc_id that links reach (null doc_ids don't
    count); root: the smallest fingerprint of the component, as a long.  Texts
    without words all have fingerprint 0 and so link to each other.  Equal
    fingerprints are handled once, so copies make no links.  One row out for
    each row in.
    """
    rows = stage(fingerprints(docs, shingle), "fingerprints")
    unique = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    links = stage(near_links(unique, unique.count(), distance), "simhash-links")
    named = stage(name_components(unique, links, "fp"), "simhash-components")
    return rows.join(named, "fp").select("doc_id", "fp", "root", "component_id")
