"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

Document statistics, standardised, go through random cosines that approximate
a Gaussian kernel.  Each partition sums its part of the normal equations; the
sums are added in a tree on the executors, and the driver solves systems whose
size is the number of cosines.  The sums are kept by fold, so that each row can
be scored by a ridge that did not see it; isotonic regression on counts of these
scores in narrow bins calibrates the ridge of all rows.  Its steps are joined by
lines between their centres, so that scores keep their order within a step.
All labelled training rows count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, stage
from .stats import RATIOS, text_statistics

#: Random cosines.
COSINES = 256
#: Width of the Gaussian kernel in standard deviations of a statistic.
WIDTH = 4.0
RIDGE = 1e-3
SEED = 8
#: Score bins of the calibration, over [LOW, HIGH].
BINS, LOW, HIGH = 4096, -1.0, 2.0
#: Parts of the training rows; each is scored by the ridge of the others.
FOLDS = 4
#: Standardised statistics are held to this range.
CLIP = 8.0


def fourier(x: np.ndarray, mean: np.ndarray, sd: np.ndarray, k: int = COSINES, width: float = WIDTH, seed: int = SEED) -> np.ndarray:
    """Rows of k random cosines and a one."""
    rng = np.random.default_rng(seed)
    w, b = rng.standard_normal((x.shape[1], k)) / width, rng.uniform(0, 2 * np.pi, k)
    z = np.clip((x - mean) / sd, -CLIP, CLIP)
    return np.hstack([np.sqrt(2 / k) * np.cos(z @ w + b), np.ones((len(x), 1))])


def pool_adjacent(total: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The non-decreasing means closest to total / count, weighted by count."""
    blocks: list[list[float]] = []  # sum, count, bins
    for t, c in zip(total.tolist(), count.tolist(), strict=True):
        blocks.append([t, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], a, strict=True)]
    return np.concatenate([np.full(int(n), t / c) for t, c, n in blocks]) if blocks else np.empty(0)


def calibration(x: np.ndarray, total: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and rising values: the centres of the steps of the isotonic regression at x, ends at 0 and 1.

    A step's mean counts half a row of each label besides, so that none is 0 or 1.
    """
    step = np.r_[0, np.cumsum(np.diff(pool_adjacent(total, count)) > 0)]
    t, c, m = (np.bincount(step, v) for v in (total, count, count * x))
    again = pool_adjacent(t + 0.5, c + 1)
    step = np.r_[0, np.cumsum(np.diff(again) > 0)]
    c, m, v = np.bincount(step, c), np.bincount(step, m), np.bincount(step, (c + 1) * again) / np.bincount(step, c + 1)
    return np.r_[LOW - 1, m / c, HIGH + 1], np.r_[0.0, v, 1.0]


@dataclass
class Model:
    mean: np.ndarray
    sd: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier(x, self.mean, self.sd) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def _matrix(col: pa.ListArray) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(RATIOS))


def fit(train: DataFrame) -> Model:
    """train: vec array<double>, y double (0 to 1), fold int (0 to FOLDS - 1)."""
    k = len(RATIOS)
    m = train.agg(F.count("*"), *[F.avg(F.col("vec")[i]) for i in range(k)], *[F.stddev_pop(F.col("vec")[i]) for i in range(k)]).head()
    none = np.empty(0)
    if not m[0]:
        return Model(np.zeros(k), np.ones(k), np.zeros(COSINES + 1), none, none)
    mean, sd = np.array(m[1 : k + 1]), np.array(m[k + 1 : 2 * k + 1])
    sd = np.where(sd > 1e-9, sd, 1.0)
    size = COSINES + 1
    shape = FOLDS, size + 2, size  # the last row: how many

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(shape)
        for b in batches:
            z, y, fold = fourier(_matrix(b.column(0)), mean, sd), b.column(1).to_numpy(), b.column(2).to_numpy()
            for f in range(FOLDS):
                zf = z[fold == f]
                acc[f, :size] += zf.T @ zf
                acc[f, size] += zf.T @ y[fold == f]
                acc[f, size + 1, 0] += len(zf)
        if acc.any():
            yield pa.RecordBatch.from_pydict({"sums": pa.array([acc.tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(shape)
        for b in batches:
            for x in b.column(0):
                acc += np.frombuffer(x.as_py()).reshape(shape)
        if acc.any():
            yield pa.RecordBatch.from_pydict({"sums": pa.array([acc.tobytes()], pa.binary())})

    def ridge(acc: np.ndarray) -> np.ndarray:
        return np.linalg.solve(acc[:size] + RIDGE * max(1.0, acc[size + 1, 0]) * np.eye(size) / size, acc[size])

    parts = arrow_map(train.select("vec", "y", "fold"), partial, "sums binary")
    for n in (64, 8):
        parts = arrow_map(parts.repartition(n), add, "sums binary")
    acc = np.zeros(shape)
    for r in parts.toLocalIterator():  # 8 rows at most, one after another
        acc += np.frombuffer(r[0]).reshape(shape)
    whole = acc.sum(0)
    model = Model(mean, sd, ridge(whole), none, none)
    others = np.array([ridge(whole - acc[f]) for f in range(FOLDS)]).T

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, c = np.zeros(BINS), np.zeros(BINS)
        for b in batches:
            fold = b.column(2).to_numpy()
            raw = (fourier(_matrix(b.column(0)), mean, sd) @ others)[np.arange(len(fold)), fold]
            at = np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)
            np.add.at(t, at, b.column(1).to_numpy())
            np.add.at(c, at, 1)
        i = np.flatnonzero(c)
        yield pa.RecordBatch.from_pydict({"bin": pa.array(i), "t": pa.array(t[i]), "c": pa.array(c[i])})

    rows = arrow_map(train.select("vec", "y", "fold"), bins, "bin long, t double, c double").groupBy("bin").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).orderBy("bin").collect()  # BINS at most
    model.knots, model.values = calibration(LOW + (np.array([r.bin for r in rows]) + 0.5) * (HIGH - LOW) / BINS, np.array([r.t for r in rows]), np.array([r.c for r in rows]))
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    labels: doc_id, quality; rows with a null in either are not used, and
    several labels of one doc_id are averaged.  Rows whose crc32(doc_id as text)
    mod 3 is 1 are held out and never learnt from; a null doc_id is not held
    out.  A null or empty text has all statistics zero and is scored like any
    other.  Without training rows every score is 0.5.  One row out for each row in.
    """
    st = stage(text_statistics(docs).select("doc_id", "vec"), "quality-vectors")
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1).alias("held_out")
    if model is None:
        y = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("double").alias("y")).dropna().groupBy("doc_id").agg(F.avg("y").alias("y"))
        y = y.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
        fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
        model = fit(stage(st.join(y, "doc_id").select("vec", "y", fold), "quality-train"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(_matrix(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return arrow_map(st.select("doc_id", held, "vec"), run, "doc_id long, held_out boolean, score double, predicted int")
