"""Exact nearest neighbours of a table of vectors in another one, by L2 distance: a join by pivots.

Some vectors are pivots, and each vector belongs to the part of its nearest one.  Of a part are
known how many vectors lie at which distance from the pivot (in narrow classes of distance), the least and the
greatest.  By the triangle inequality these bound, for a query, the distance of
its k-th nearest row from above, and that of any row of a part from below: the
query goes only to parts that can hold a nearer row than that bound, and there
only to rows whose distance from the pivot is near enough to its own.  Queries are a DataFrame that stays
on the executors, and the plan is the same for any number of them.  A large part is cut into slices, the
queries of a part into blocks, so no group in a task grows with the tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Pivots of vectors of one length, at most.
PIVOTS = 64
#: Classes of distance in each doubling.
STEPS = 8
#: Rows in a slice of a part and queries in a block, about.
SLICE, BLOCK = 4096, 2048
#: Distances are rounded before they are ranked.
DIGITS = 9
_SLACK = 1e-9


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a from each row of b."""
    return np.stack([np.sqrt(((a - x) ** 2).sum(1)) for x in b], 1)


def _by_length(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix) of vectors of one length each."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield int(n), at, _matrix(vectors.take(pa.array(at)))


class Parts:
    """What is known of the parts: pivots by length of vector, classes of distance with their counts, bounds, slices and blocks."""

    def __init__(self, pivots: dict[int, np.ndarray]) -> None:
        self.pivots = pivots
        self.first = dict(zip(pivots, np.cumsum([0, *(len(p) for p in pivots.values())]).tolist(), strict=False))
        n = sum(len(p) for p in pivots.values())
        self.least, self.most = np.full(n, np.inf), np.full(n, -np.inf)
        self.slices, self.blocks = np.zeros(n, np.int64), np.ones(n, np.int64)
        self.classes: list[list[tuple[float, int]]] = [[] for _ in range(n)]

    def of(self, n: int, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Part and distance from its pivot of each row of m (vectors of length n)."""
        d = _distances(m, self.pivots[n])
        near = d.argmin(1)
        return self.first[n] + near, d[np.arange(len(m)), near]

    def learn(self, part: int, step: int, count: int, least: float, most: float) -> None:
        self.least[part], self.most[part] = min(self.least[part], least), max(self.most[part], most)
        self.classes[part].append((most, count))

    def close(self) -> None:
        counts = np.array([sum(c for _, c in x) for x in self.classes], np.int64)
        self.slices = -(-counts // SLICE)

    def reach(self, n: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For queries of length n: distances from the pivots, the bound on the k-th distance, and which parts can hold a nearer row."""
        lo, hi = self.first[n], self.first[n] + len(self.pivots[n])
        d = _distances(q, self.pivots[n])
        at = np.array([p - lo for p in range(lo, hi) for _ in self.classes[p]], np.int64)
        far = np.array([r for p in range(lo, hi) for r, _ in self.classes[p]])
        count = np.array([c for p in range(lo, hi) for _, c in self.classes[p]], np.int64)
        upper = d[:, at] + far
        order = upper.argsort(1)
        enough = np.cumsum(count[order], 1) >= k
        bound = np.where(enough.any(1), np.take_along_axis(upper, order, 1)[np.arange(len(q)), enough.argmax(1)], np.inf)
        bound = bound * (1 + _SLACK) + _SLACK
        lower = np.maximum(d - self.most[lo:hi], self.least[lo:hi] - d)
        own = d.argmin(1)
        apart = _distances(self.pivots[n], self.pivots[n])[own]  # of each pivot from the query's own
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (d**2 - d[np.arange(len(q)), own][:, None] ** 2) / (2 * apart)
        lower = np.maximum(lower, np.where(apart > 0, plane, 0))  # rows of a part are on its side of the plane between
        return d, bound, (lower <= bound[:, None] * (1 + _SLACK)) & (self.slices[lo:hi] > 0)


def _parts(rows: DataFrame) -> Parts:
    """Pivots by a hash of the id, and one row for each class of distance of a part: both bounded by PIVOTS, whatever the table's size."""
    which = rows.groupBy(F.size("embedding").alias("n"), F.pmod(F.xxhash64("para_id"), F.lit(PIVOTS)).alias("h")).agg(F.min_by("embedding", "para_id").alias("v"))
    pivots: dict[int, list] = {}
    for r in which.orderBy("n", "h").collect():
        pivots.setdefault(r["n"], []).append(list(r["v"]))
    parts = Parts({n: np.unique(np.array(v, np.float64), axis=0) for n, v in pivots.items()})

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, _, m in _by_length(b.column(0)):
                part, d = parts.of(n, m)
                step = np.floor(np.log2(np.maximum(d, 1e-300)) * STEPS).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"part": part, "step": step, "d": d})

    found = rows.select("embedding").mapInArrow(classes, "part long, step long, d double").groupBy("part", "step").agg(F.count("*").alias("n"), F.min("d").alias("least"), F.max("d").alias("most"))
    for r in found.collect():
        parts.learn(r["part"], r["step"], r["n"], r["least"], r["most"])
    parts.close()
    return parts


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def knn_join(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, para_id, distance, rank, compared: the k nearest rows of each query, ties to the smaller para_id.

    vectors: para_id, embedding; queries: query_id (of one row each), qvec; nulls take no part, and only vectors of a query's
    length are its neighbours.  compared: of how many rows the query's distance was computed.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    rows = vectors.select("para_id", "embedding").filter("embedding IS NOT NULL AND size(embedding) > 0")
    asked = queries.select("query_id", F.col("qvec").cast("array<double>").alias("qvec")).filter("qvec IS NOT NULL AND size(qvec) > 0")
    id_kind, row_kind = _kind(asked, "query_id"), _kind(rows, "para_id")
    parts = _parts(rows)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries, once for each part that they have to see."""
        for b in batches:
            for n, at, q in _by_length(b.column(1)):
                if n not in parts.pivots or not k:
                    continue
                d, bound, sees = parts.reach(n, q, k)
                i, j = np.nonzero(sees)
                place = pa.array(at[i])
                yield pa.RecordBatch.from_arrays([b.column(0).take(place), b.column(1).take(place), pa.array(parts.first[n] + j), pa.array(d[i, j]), pa.array(bound[i])], ["query_id", "qvec", "part", "away", "bound"])

    routed = asked.mapInArrow(route, f"query_id {id_kind}, qvec array<double>, part long, away double, bound double")
    for r in routed.groupBy("part").count().collect():  # a row for each part at most
        parts.blocks[r["part"]] = -(-r["count"] // BLOCK)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, at, m in _by_length(b.column(1)):
                part, d = parts.of(n, m)
                piece = b.column(2).to_numpy().view(np.uint64)[at] % parts.slices[part].astype(np.uint64)
                place = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(place), b.column(1).take(place), pa.array(part), pa.array(piece.astype(np.int64)), pa.array(d), pa.array(parts.blocks[part])], ["para_id", "embedding", "part", "piece", "d", "blocks"])

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries, once for each slice of their parts, with the block that they are in."""
        for b in batches:
            part = b.column(2).to_numpy()
            many = parts.slices[part]
            at = np.repeat(np.arange(len(part)), many)
            piece = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            block = (b.column(5).to_numpy().view(np.uint64) % parts.blocks[part].astype(np.uint64)).astype(np.int64)
            place = pa.array(at)
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(place) for i in range(5)), pa.array(piece), pa.array(block[at])], ["query_id", "qvec", "part", "away", "bound", "piece", "block"])

    left = rows.withColumn("h", F.xxhash64("para_id")).mapInArrow(deal, f"para_id {row_kind}, embedding {_kind(rows, 'embedding')}, part long, piece long, d double, blocks long")
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    right = routed.withColumn("h", F.xxhash64("query_id")).mapInArrow(copies, f"query_id {id_kind}, qvec array<double>, part long, away double, bound double, piece long, block long")
    key = ["part", "piece", "block"]

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        """The k nearest of a slice's rows for each query of a block."""
        out = []
        if a.num_rows and b.num_rows:
            a = a.sort_by("d")
            m, d, ids = _matrix(a.column("embedding").combine_chunks()), a.column("d").to_numpy(), a.column("para_id").combine_chunks()
            q, away, bound = _matrix(b.column("qvec").combine_chunks()), b.column("away").to_numpy(), b.column("bound").to_numpy()
            lo = np.searchsorted(d, away - bound * (1 + _SLACK) - _SLACK)
            hi = np.searchsorted(d, away + bound * (1 + _SLACK) + _SLACK, "right")
            for i in np.flatnonzero(hi > lo):
                far = np.round(np.sqrt(((m[lo[i] : hi[i]] - q[i]) ** 2).sum(1)), DIGITS)
                some = np.flatnonzero(far <= (np.partition(far, k - 1)[k - 1] if len(far) > k else np.inf))
                best = pa.table({"distance": far[some], "para_id": ids.take(pa.array(lo[i] + some))})
                best = best.take(pc.sort_indices(best, sort_keys=[("distance", "ascending"), ("para_id", "ascending")])[:k])
                n = best.num_rows
                who = b.column("query_id").combine_chunks().take(pa.array(np.full(n, i)))
                out.append(pa.table([who, best.column("para_id"), best.column("distance"), pa.array([int(hi[i] - lo[i]), *[0] * (n - 1)], pa.int64())], names=["query_id", "para_id", "distance", "compared"]))
        if not out:
            return pa.table({"query_id": b.column("query_id").slice(0, 0), "para_id": a.column("para_id").slice(0, 0), "distance": pa.array([], pa.float64()), "compared": pa.array([], pa.int64())})
        return pa.concat_tables(out)

    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, f"query_id {id_kind}, para_id {row_kind}, distance double, compared long")
    order = W.partitionBy("query_id").orderBy("distance", "para_id")
    near = near.withColumn("rank", F.row_number().over(order)).withColumn("compared", F.sum("compared").over(W.partitionBy("query_id")))
    return near.filter(F.col("rank") <= k).select("query_id", "para_id", "distance", "rank", "compared")
