"""SimHash near-duplicates whose links are checked by the resemblance (Jaccard) of the sets of shingles.

Anchor-point covering finds what is within a few bits, and the exact check keeps
the links that are as near as asked.  Pairs at a resemblance of 0.8 differ in
about ten bits, though, and no covering of that distance is affordable.  So the
shingles of each set are also put in one order, rare ones first: two sets that
share at least 0.8 of their union share a shingle among the first fifth of each,
so all such pairs meet at one.  Of what meets, the pairs whose sizes and places leave
it open that they are near are compared by all their shingles.  That goes in
rounds, the first of which compare each set to a few others; pairs that links
found earlier connect already are passed over.  The last round takes all that
are left, but for those that parity bits exclude: each shingle turns one of so many bits of
its set over, so two sets differ in at least as many shingles as their bits differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, drop_path, only, stage, strings, u64
from .components import connected_components, name_components
from .simhash import AT_ONCE, DISTANCE, majority, near_links, shingle_hashes

SHINGLE = 5
#: Near: |a & b| / |a | b| >= NEAR[0] / NEAR[1].
NEAR = (4, 5)
#: Documents (about) in which common shingles are counted, and how many of these are told apart. They only set the order.
SAMPLE = 10_000
COMMON = 10_000
#: Places of a set at which it is compared to one other of the group before all pairs are; of those in larger groups, one in so many besides.
FIRST_TRIES = 4
LARGE = 8
ONE_IN = 8

#: Others that a set is compared to at each of its shingles, by round (None: all), and what orders the components in each.
ROUNDS = (2, None)
ORDERS = (0, 0x5DEECE66D1234567)

#: Parity bits of a set.
BITS = 2048

_GROUP = "anchor long, sig long, n int, at int, centre long"


def shingle_set(text: str) -> np.ndarray:
    """The distinct shingles, sorted."""
    return np.unique(shingle_hashes(text, SHINGLE))


def signature(s: np.ndarray) -> int:
    """64 bits of the whole set; 0 for the empty one."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that repeat in a sample of documents, sorted, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in strings(b.column(0)):
                yield pa.RecordBatch.from_arrays([u64(shingle_set(t))], ["h"])

    n = docs.count()
    some = only(docs, text="string") if n <= SAMPLE else only(docs, text="string").sample(SAMPLE / n, seed=1)
    rows = arrow_map(some, run, "h long").groupBy("h").count().filter("count > 1").orderBy(F.desc("count"), "h").limit(COMMON).collect()
    h, count = np.array([r["h"] for r in rows], np.int64).view(np.uint64), np.array([r["count"] for r in rows], np.int64)
    order = np.argsort(h)
    return h[order], count[order]


def prefix(s: np.ndarray, common: np.ndarray, count: np.ndarray) -> np.ndarray:
    """As many shingles, rarest first, that every near set has one of them in its own prefix."""
    n, (p, q) = len(s), NEAR
    keep = n + (-p * n // q) + 1
    if not len(common):
        return s[:keep]
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    return s[np.lexsort((s, np.where(common[at] == s, count[at], 0)))[:keep]]


def possible(n: np.ndarray, at: np.ndarray, m: np.ndarray, bt: np.ndarray) -> np.ndarray:
    """Whether sets of sizes n and m whose first common shingle is at these places can be near."""
    p, q = NEAR
    return (p + q) * np.minimum(n - at, m - bt) >= p * (n + m)


def parity(s: np.ndarray) -> bytes:
    return np.packbits((np.bincount((s % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes()


def parity_allows(n: np.ndarray, x: np.ndarray, m: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets of sizes n and m with parity bits x and y (rows of 64-bit words) can be near: they differ in (n + m) (q - p) / (q + p) shingles at most then."""
    p, q = NEAR
    return (p + q) * np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= (q - p) * (n.astype(np.int64) + m)


def near(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return NEAR[1] * both >= NEAR[0] * (len(a) + len(b) - both)


def _sketches(docs: DataFrame) -> DataFrame:
    """doc_id, sig of every row; n, fp, prefix, packed (the text) once in each partition for a sig."""
    common, count = common_shingles(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, seen = zstandard.ZstdCompressor(3), {0}
        for b in batches:
            sigs, sizes, fps, firsts, packed = [], [], [], [], []
            for t in strings(b.column(1)):
                s = shingle_set(t)
                sigs.append(signature(s))
                new = sigs[-1] not in seen
                seen.add(sigs[-1])
                sizes.append(len(s))
                fps.append(majority(s[i : i + AT_ONCE] for i in range(0, len(s), AT_ONCE)) if new else 0)
                firsts.append(prefix(s, common, count).view(np.int64) if new else None)
                packed.append(z.compress(t.encode()) if new else None)
            yield pa.RecordBatch.from_arrays([b.column(0), u64(np.array(sigs, np.uint64)), pa.array(sizes, pa.int32()), u64(np.array(fps, np.uint64)), pa.array(firsts, pa.list_(pa.int64())), pa.array(packed, pa.binary())], ["doc_id", "sig", "n", "fp", "prefix", "packed"])

    return stage(arrow_map(only(docs, doc_id="long", text="string"), run, "doc_id long, sig long, n int, fp long, prefix array<long>, packed binary"), "shingles")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Batches sorted by their first column, cut so that no group is in two; binary columns become rows of 64-bit words."""
    held: list[list[np.ndarray]] = []

    def plain(c: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(len(c), -1) if pa.types.is_binary(c.type) else c.to_numpy()

    for b in batches:
        if not b.num_rows:
            continue
        held.append([plain(c) for c in b.columns])
        if held[0][0][0] == held[-1][0][-1]:
            continue  # one group so far
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
        yield [c[:cut] for c in cols]
        held = [[c[cut:] for c in cols]]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _bounds(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the run of equal keys that each row is in."""
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, len(new)])
    return np.repeat(first, size), np.repeat(first + size, size)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of anchors that several sets have, each with another of its group to try first (null: none)."""
    for k, sig, n, at in _whole_groups(batches):
        once = np.r_[True, (k[1:] != k[:-1]) | (sig[1:] != sig[:-1])]
        k, sig, n, at = k[once], sig[once], n[once], at[once]
        lo, hi = _bounds(k)
        c = lo + (k.view(np.uint64) % (hi - lo).astype(np.uint64)).astype(np.int64)
        late = (at >= FIRST_TRIES) & ((hi - lo <= LARGE) | ((k ^ sig) % ONE_IN != 0))
        none = (c == np.arange(len(k))) | late | ~possible(n, 0, n[c], 0)
        some = hi - lo > 1
        yield pa.RecordBatch.from_arrays([pa.array(k[some]), pa.array(sig[some]), pa.array(n[some]), pa.array(at[some]), pa.array(sig[c][some], mask=none[some])], ["anchor", "sig", "n", "at", "centre"])


def _open(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Over rows (anchor, root, sig, n, at, and parity bits if known) sorted by anchor and root: groups, and the places of pairs there that can be near.

    Pairs of one root are passed over; all others come, or so many of each row.
    """
    for cols in _whole_groups(batches):
        k, root, _, n, at, *bits = cols
        nxt, end = _bounds(k, root)[1], _bounds(k)[1]
        i = np.flatnonzero(nxt < end)
        made = np.zeros(len(k), np.int64)
        lag = 0
        while len(i):
            j = nxt[i] + lag
            ok = possible(n[i], at[i], n[j], at[j])
            a, b = i[ok], j[ok]
            if bits:
                fits = parity_allows(n[a], bits[0][a], n[b], bits[0][b])
                a, b = a[fits], b[fits]
            yield cols, a, b
            made[a] += 1
            lag += 1
            i = i[(nxt[i] + lag < end[i]) & (most is None or made[i] < most)]


def _pairs(most: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, sig, *_), i, j in _open(batches, most):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(sig[i], sig[j])), pa.array(np.maximum(sig[i], sig[j]))], ["a", "b"])

    return run


def _in_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that some pair needs."""
    last, needed = None, np.empty(0, bool)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c[needed]) for c in last], ["anchor", "root", "sig", "n", "at"])

    for cols, i, j in _open(batches, None):
        if cols is not last:
            if last is not None:
                yield out()
            last, needed = cols, np.zeros(len(cols[0]), bool)
        needed[i] = needed[j] = True
    if last is not None:
        yield out()


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdDecompressor()
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([parity(shingle_set(z.decompress(x).decode())) for x in b.column(1).to_pylist()], pa.binary())], ["sig", "bits"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z, last = zstandard.ZstdDecompressor(), {}

    def get(sig: int, packed: bytes) -> np.ndarray:
        if sig not in last:
            if len(last) >= 64:
                del last[next(iter(last))]
            last[sig] = shingle_set(z.decompress(packed).decode())
        return last[sig]

    for b in batches:
        ok = [near(get(x, s), get(y, t)) for x, y, s, t in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok, pa.bool_())), b.column(1).filter(pa.array(ok, pa.bool_()))], ["a", "b"])


def _texts(sketches: DataFrame, sigs: DataFrame, tag: str) -> DataFrame:
    """sig, packed: one text of each of the sets."""
    texts = sketches.filter("packed IS NOT NULL").select("sig", "packed").join(sigs.distinct(), "sig", "left_semi")
    return stage(texts.groupBy("sig").agg(F.min("packed").alias("packed")), f"{tag}-texts")


def _verified(pairs: DataFrame, sketches: DataFrame, tag: str) -> DataFrame:
    """Those of the pairs (a, b) that are near."""
    texts = _texts(sketches, pairs.select(F.col("a").alias("sig")).union(pairs.select("b")), tag)
    left, right = texts.select(F.col("sig").alias("a"), F.col("packed").alias("s")), texts.select(F.col("sig").alias("b"), F.col("packed").alias("t"))
    links = stage(arrow_map(pairs.join(left, "a").join(right, "b").select("a", "b", "s", "t"), _compare, "a long, b long"), f"{tag}-links")
    _drop(texts)
    return links


def _drop(staged: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in staged.inputFiles()}:
        drop_path(staged.sparkSession, path)


def covered(rows: DataFrame, distance: int) -> DataFrame:
    """a, b: pairs of signatures that link fingerprints within `distance` bits, by anchor-point covering, or have the same one."""
    fps = stage(rows.filter("prefix IS NOT NULL").select("fp", "sig").distinct(), "set-fingerprints")
    first = stage(fps.groupBy("fp").agg(F.min("sig").alias("a")), "first-of-fingerprints")
    links = stage(near_links(first, first.count(), distance).distinct(), "set-links")
    same = fps.join(first, "fp").filter("sig <> a").select("a", F.col("sig").alias("b"))
    x, y = first.select(F.col("fp").alias("a"), F.col("a").alias("x")), first.select(F.col("fp").alias("b"), F.col("a").alias("y"))
    return same.unionByName(links.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, component_id for every row of docs.

    component_id: the smallest doc_id that links reach (null doc_ids don't
    count).  Texts without words link to each other.  Equal sets of shingles are
    handled once.  One row out for each row in.
    """
    rows = _sketches(docs)
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // 50_000)
    copies = rows.filter("prefix IS NOT NULL").select("sig", "n", F.posexplode("prefix").alias("at", "anchor")).select("anchor", "sig", "n", "at")
    shared = stage(arrow_map(copies.repartition(n, "anchor").sortWithinPartitions("anchor", "sig"), _meet, _GROUP), "shared-shingles")
    tries = shared.filter("centre IS NOT NULL").select(F.least("sig", "centre").alias("a"), F.greatest("sig", "centre").alias("b"))
    tries = stage(tries.unionByName(covered(rows, distance)).distinct(), "first-pairs")
    links = _verified(tries, rows, "first")
    for k, (most, order) in enumerate(zip(ROUNDS, ORDERS, strict=True)):
        roots = connected_components(links).withColumnRenamed("node", "sig")
        named = shared.join(roots, "sig", "left").select("anchor", F.coalesce("root", "sig").bitwiseXOR(F.lit(order)).alias("root"), "sig", "n", "at")
        dealt = lambda df: df.repartition(n, "anchor").sortWithinPartitions("anchor", "root", "sig")
        if most is None:
            named = stage(arrow_map(dealt(named), _in_pairs, "anchor long, root long, sig long, n int, at int"), "undecided")
            texts = _texts(rows, named.select("sig"), "undecided")
            bits = stage(arrow_map(texts, _parities, "sig long, bits binary"), "parities")
            named = named.join(bits, "sig").select("anchor", "root", "sig", "n", "at", "bits")
        pairs = arrow_map(dealt(named), _pairs(most), "a long, b long").distinct()
        pairs = stage(pairs.join(tries, ["a", "b"], "left_anti"), f"pairs-{k}")
        links, tries = links.union(_verified(pairs, rows, f"round-{k}")), tries.union(pairs)
    _drop(shared)
    named = stage(name_components(stage(rows.groupBy("sig").agg(F.min("doc_id").alias("least")), "signatures"), links, "sig"), "components")
    out = stage(rows.select("doc_id", "sig").join(named, "sig").select("doc_id", "component_id"), "near-duplicates")
    _drop(rows)
    return out
