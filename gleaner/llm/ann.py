"""Approximate nearest neighbours by an inverted multi-index.

The dimensions of unit vectors are dealt to two halves of like variance, each
quantised with its own codebook, so that K centroids a half make K * K cells.  A
query takes the cells by the sum of its two half distances, with a heap, until
they hold a certain share of the distinct vectors; these are ranked by exact
cosine of the original vectors.  The share is what queries of the sample need to
find RECALL of their neighbours in the sample: little where vectors cluster,
much where they don't.  As neighbours are nearer in the whole than in a sample,
it errs on the side of finding more.

Equal vectors are indexed once, with the few smallest ids that any answer can
need.  Neighbouring cells lie together on shelves of bounded size, a crowded cell
on several; a query goes once to each shelf that has cells of its, with a bit for
each cell, and is compared with those cells alone.  Vectors of each length have
an index of their own; where they are few, it is one cell.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, sized_join, stage

TOP = 5
#: Centroids of each half: the power of two with about PER_CELL vectors a cell, MOST at most.
PER_CELL, MOST = 8, 256
#: Vectors that the codebooks are fitted on, at most; every vector is indexed.
SAMPLE = 20_000
#: Neighbours that the sample's own queries must find, and how many such queries there are.
RECALL, TRIALS = 0.95, 200
#: Vectors of a shelf, about.
BLOCK = 2048
#: Up to so many vectors of one length are one cell.
FEW = 256
ROUNDS = 12
SEED = 5


def usable(v: np.ndarray | None) -> bool:
    return v is not None and len(v) > 0 and bool(np.isfinite(v).all()) and bool(v.any())


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's rounds from distinct seeded rows; an empty cluster keeps its centroid."""
    rng = np.random.default_rng(SEED)
    x = np.unique(x, axis=0)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)


def traverse(d1: np.ndarray, d2: np.ndarray, counts: list[int], take: int) -> list[int]:
    """Cells i * len(d2) + j in order of d1[i] + d2[j] until they hold `take` vectors; empty ones are passed over.

    The heap holds the next cell of each row of the grid that has been begun.
    """
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    a, b, row, col = d1[o1].tolist(), d2[o2].tolist(), (o1 * len(d2)).tolist(), o2.tolist()
    heap, out, got, last = [(a[0] + b[0], 0, 0)], [], 0, len(b) - 1
    while heap and got < take:
        _, i, j = heap[0]
        cell = row[i] + col[j]
        if n := counts[cell]:
            out.append(cell)
            got += n
        if j < last:
            heapq.heapreplace(heap, (a[i] + b[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return out


def calibrate(u: np.ndarray, books: list[np.ndarray], halves: list[np.ndarray], top: int) -> float:
    """Share of the vectors u (unit length) that a query must visit to find RECALL of its neighbours among them."""
    cell = cells(u, books, halves)
    counts = np.bincount(cell, minlength=len(books[0]) * len(books[1]))
    needed = []
    for q in np.linspace(0, len(u) - 1, min(TRIALS, len(u))).astype(int):
        s = u @ u[q]
        s[q] = -2
        best = np.argsort(-s)[:top]
        d = [((c - u[q, h]) ** 2).sum(1) for c, h in zip(books, halves, strict=True)]
        order = np.argsort((d[0][:, None] + d[1]).ravel(), kind="stable")  # as traverse has it, to the end
        done = np.empty(len(counts), np.int64)
        done[order] = np.cumsum(counts[order])
        needed += done[cell[best]].tolist()
    return float(np.quantile(needed, RECALL)) / len(u)


def cells(u: np.ndarray, books: list[np.ndarray], halves: list[np.ndarray]) -> np.ndarray:
    return nearest(u[:, halves[0]], books[0]) * len(books[1]) + nearest(u[:, halves[1]], books[1])


@dataclass
class Index:
    """What places vectors of one length, and where their cells lie."""

    books: list[np.ndarray]
    halves: list[np.ndarray]
    share: float
    counts: list[int] | None = None
    take: int = 0
    shelf: np.ndarray | None = None  # the first shelf of each cell
    copies: np.ndarray | None = None  # how many it has
    first: np.ndarray | None = None  # the first cell of the shelf of each cell

    @classmethod
    def fit(cls, x: np.ndarray, n: int, top: int, share: float | None, centroids: int | None) -> Index:
        """x: a sample, unit length, of n vectors."""
        x = x[np.lexsort(x.T[::-1])]
        dims = np.argsort(-x.var(0), kind="stable")
        halves = [np.sort(dims[0::2]), np.sort(dims[1::2])]
        k = centroids or max(4, min(MOST, 1 << round(np.log2(max(1.0, n / PER_CELL)) / 2)))
        books = [kmeans(x[:, h], k) if len(h) else np.zeros((1, 0)) for h in halves]
        return cls(books, halves, share or calibrate(x, books, halves, top))

    def lay(self, counts: np.ndarray, at: int) -> int:
        """Give the cells their shelves from number `at` on; the next free number."""
        self.counts, self.take = counts.tolist(), int(-(-counts.sum() * self.share // 1))
        self.copies = np.maximum(1, -(-counts // BLOCK))
        self.shelf, self.first = np.empty(len(counts), np.int64), np.empty(len(counts), np.int64)
        held, first = 0, 0
        for c, n in enumerate(counts.tolist()):
            if c > first and (held + n > BLOCK or self.copies[c - 1] > 1):
                at, held, first = at + int(self.copies[c - 1]), 0, c
            self.shelf[c], self.first[c], held = at, first, held + n
        return at + int(self.copies[-1])

    def wanted(self, v: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(shelf, a bit for each of its cells) of a query's cells."""
        u = unit(v[None])[0]
        want = np.zeros(len(self.counts), bool)
        want[traverse(*[((c - u[h]) ** 2).sum(1) for c, h in zip(self.books, self.halves, strict=True)], self.counts, self.take)] = True
        at = np.flatnonzero(want)
        for f in np.unique(self.first[at]).tolist():
            last = f + int(np.searchsorted(self.first[f:], f, "right"))
            bits = np.packbits(want[f:last]).tobytes()
            for s in range(int(self.copies[f])):
                yield int(self.shelf[f]) + s, bits


def cosine(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """In double precision, row by row, so that equal vectors have equal scores."""
    return (m * q).sum(1) / (np.sqrt((m * m).sum(1)) * np.sqrt((q * q).sum(1)))


def nearest_neighbours(vectors: DataFrame, every: int = 50, top: int = TOP, share: float | None = None, centroids: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` nearest found of every row whose vec_id is divisible by `every`.

    vectors: vec_id, embedding (array of numbers).  Vectors that are null,
    empty, zero or hold null or non-finite components, and rows with a null
    vec_id, take no part.  A vector's candidates are all rows with vectors of its
    length, but the query's own row: rows that repeat its vec_id are candidates,
    and each row that is a query has an answer of its own.  Ties go to the
    smaller vec_id.
    """
    spark = vectors.sparkSession
    keep = top + 1  # of a vector's ids any answer needs these at most: the query's own may be one
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vecs, keys = [], [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                a = v.values.to_numpy()
                if usable(a):
                    ids.append(i)
                    vecs.append(a)
                    keys.append(xxhash.xxh3_128_digest((a + 0.0).tobytes()))  # -0 is 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(list(map(len, vecs)), pa.int32()), lists(vecs)], ["vec_id", "key", "n", "v"])

    def lists(vecs: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *map(len, vecs)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(vecs) if vecs else np.empty(0)))

    rows = stage(arrow_map(vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")), clean, "vec_id long, key binary, n int, v array<double>"), "vectors")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The smallest ids of each vector of this partition."""
        got: dict[bytes, list] = {}
        vec: dict[bytes, pa.Scalar] = {}
        for b in batches:
            for i, k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
                x = got.setdefault(k, [])
                if len(x) < keep or i < x[-1]:
                    got[k] = sorted([*x, i])[:keep]
                    vec.setdefault(k, v)
            if len(got) > 20_000:
                yield put(got, vec)
                got, vec = {}, {}
        yield put(got, vec)

    def put(got, vec):
        vecs = [vec[k].values.to_numpy() for k in got]
        return pa.RecordBatch.from_arrays([pa.array(list(got), pa.binary()), pa.array(list(got.values()), pa.list_(pa.int64())), pa.array(list(map(len, vecs)), pa.int32()), lists(vecs)], ["key", "ids", "n", "v"])

    unique = arrow_map(rows, local, "key binary, ids array<long>, n int, v array<double>").groupBy("key").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids"), F.first("n").alias("n"), F.first("v").alias("v"))
    unique = stage(unique, "distinct-vectors")
    made: dict[int, Index] = {}
    for r in unique.groupBy("n").count().filter(F.col("count") > FEW).orderBy("n").collect():  # a row for each length with many vectors
        mine = unique.filter(F.col("n") == r["n"])
        sample = mine.orderBy(F.xxhash64("key"), "key").limit(SAMPLE) if r["count"] > SAMPLE else mine
        made[r["n"]] = Index.fit(unit(np.array([x[0] for x in sample.select("v").collect()], np.float64)), r["count"], top, share, centroids)  # SAMPLE rows at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, cell = b.column(2).to_numpy(), np.zeros(b.num_rows, np.int64)
            for size in set(n.tolist()) & set(made):
                at = np.flatnonzero(n == size)
                cell[at] = cells(unit(b.column(3).take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1)), made[size].books, made[size].halves)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], ["key", "ids", "n", "v", "cell"])

    index = stage(arrow_map(unique, place, "key binary, ids array<long>, n int, v array<double>, cell long"), "multi-index")
    counts = {n: np.zeros(len(x.books[0]) * len(x.books[1]), np.int64) for n, x in made.items()}
    for r in index.filter(F.col("n").isin(list(made))).groupBy("n", "cell").count().collect():  # a row for each cell
        counts[r["n"]][r["cell"]] = r["count"]
    at = 0
    for n, x in made.items():
        at = x.lay(counts[n], at)

    shape = "shelf long, query_id long, key binary, ids array<long>, v array<double>, pos int, bits binary"
    names = [c.split()[0] for c in shape.split(", ")]

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shelf, pos = [], []
            for k, n, c in zip(*(b.column(i).to_pylist() for i in (0, 2, 4)), strict=True):
                x = made.get(n)
                shelf.append(int(x.shelf[c]) + int.from_bytes(k[:4], "little") % int(x.copies[c]) if x else -1 - n)
                pos.append(c - int(x.first[c]) if x else 0)
            nulls = pa.nulls(b.num_rows, pa.int64()), pa.nulls(b.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(shelf, pa.int64()), nulls[0], b.column(0), b.column(1), b.column(3), pa.array(pos, pa.int32()), nulls[1]], names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, vecs = [], []
            for i, k, n, v in zip(*(b.column(c).to_pylist() for c in range(3)), b.column(3), strict=True):
                a = v.values.to_numpy()
                for shelf, bits in made[n].wanted(a) if n in made else [(-1 - n, b"\x80")]:
                    out.append((shelf, i, k, bits))
                    vecs.append(a)
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.nulls(len(out), pa.list_(pa.int64())), lists(vecs), pa.nulls(len(out), pa.int32()), pa.array(cols[3], pa.binary())], names)

    queries = stage(rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id", "key").agg(F.first("n").alias("n"), F.first("v").alias("v"), F.count("*").alias("times")), "queries")
    both = arrow_map(index, file, shape).unionByName(arrow_map(queries.select("vec_id", "key", "n", "v").repartition(parts), ask, shape))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by shelf, index rows first, by cell: the shelf, then the queries against their cells of it."""
        shelf, m = None, None
        held: list[np.ndarray] = []
        ids: list[list[int]] = []
        keys: list[bytes] = []
        pos: list[int] = []
        best: dict[tuple[int, bytes], list[tuple[float, int]]] = {}  # of each query, on all shelves of this task

        def told() -> pa.RecordBatch:
            rows = [(*q, i, -x) for q, found in best.items() for x, i in sorted(found)[:top]]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64())], ["query_id", "key", "vec_id", "score"])

        def search(q: np.ndarray, own: list[tuple[int, bytes]], bits: list[bytes]) -> None:
            wanted = np.unpackbits(np.array([np.frombuffer(x, np.uint8) for x in bits]), axis=1).astype(bool)
            s = np.full((len(m), len(q)), -np.inf)
            for c, i, j in spans:
                k = np.flatnonzero(wanted[:, c])
                if len(k):
                    s[i:j, k] = m[i:j] @ q[k].T
            s /= size[:, None]
            least = np.partition(s, len(s) - keep, axis=0)[len(s) - keep] if len(s) > keep else np.full(len(q), -np.inf)
            j, k = np.nonzero((s > -np.inf) & (s >= np.where(np.isinf(least), -np.inf, least - 1e-9 * (1 + np.abs(np.where(np.isinf(least), 0, least))))))
            for a, b, x in zip(j.tolist(), k.tolist(), cosine(m[j], q[k]).tolist(), strict=True):
                mine = ids[a]
                if keys[a] == own[b][1] and own[b][0] in mine:  # one row of these is the query itself
                    mine = mine.copy()
                    mine.remove(own[b][0])
                found = best.setdefault(own[b], [])
                found += [(-x, i) for i in mine]
                if len(found) > 16 * top:
                    found[:] = sorted(found)[:top]

        for b in batches:
            number, asks = b.column(0).to_numpy(), b.column(1).is_valid().to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (asks[1:] != asks[:-1])][: len(number)])
            for i, j in zip(first.tolist(), [*first[1:].tolist(), len(number)], strict=True):
                if number[i] != shelf:
                    shelf, held, ids, keys, pos, m = number[i], [], [], [], [], None
                part = b.slice(i, j - i)
                v = part.column(4).flatten().to_numpy().reshape(j - i, -1)
                if not asks[i]:
                    held.append(v)
                    keys += part.column(2).to_pylist()
                    ids += part.column(3).to_pylist()
                    pos += part.column(5).to_pylist()
                elif held:
                    if m is None:
                        m = np.concatenate(held)
                        size = np.sqrt((m * m).sum(1))
                        cut = np.flatnonzero(np.r_[True, np.diff(pos) != 0]).tolist()
                        spans = list(zip([pos[c] for c in cut], cut, [*cut[1:], len(pos)], strict=True))
                    for k in range(0, j - i, 1024):
                        some = part.slice(k, 1024)
                        search(v[k : k + 1024], list(zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True)), some.column(6).to_pylist())
            if len(best) > 100_000:
                yield told()
        yield told()

    found = arrow_map(both.repartition(parts, "shelf").sortWithinPartitions("shelf", F.col("query_id").asc_nulls_first(), "pos"), rank, "query_id long, key binary, vec_id long, score double")
    w = W.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    again = queries.filter("times > 1").select(F.col("vec_id").alias("query_id"), "key", "times")
    found = sized_join(found, again, ["query_id", "key"]).withColumn("_t", F.explode(F.sequence(F.lit(1), F.coalesce(F.col("times"), F.lit(1)).cast("int"))))
    return found.select("query_id", "rank", "vec_id", "score")
