"""Quality rules: robust multivariate outliers by minimum covariance determinant.

For each language and source, the h share of rows whose covariance has the least
determinant is sought by C-steps: distances under the present estimate, the h
rows with the smallest, their mean and covariance, again until the determinant
stays.  A group of up to CHUNK different rows is solved in one task, from several
starts.  A larger one is dealt by a hash of the rows to chunks of about that size
(copies of a row are one with a weight), each solved likewise; the best estimate
then goes through C-steps over all rows of the group, under the same rule for
their end.  Such a step is one pass: every task sums moments of the rows it reads,
for narrow bins of the distance, and the bins up to the h-th row (of the one that
holds it, the share that is wanted) give the next estimate.  The present estimates
of at most GROUPS groups go to the tasks, so no row is joined.  No row is left
out.  The sums are of whole numbers, so they don't depend on how rows are dealt out.

Groups with fewer rows than LEAST for each dimension are pooled by language, and
those pools, if too small themselves, into one; least spreads keep the
covariance of even a single row invertible.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, new_path, prepare, sized_join, stage
from .stats import RATIOS, text_statistics

#: Transformed statistics that make the vector, and the least spread that each is given.
FEATURES = {"log_words": 0.25, "word_len": 0.05, "symbols": 0.25, "upper": 0.25, "punct": 0.25, "distinct": 0.05, "entropy": 0.05, "compress": 0.05}
#: Share of a group's rows that its estimate rests on.
SHARE = 0.6
#: Distances are held against those of a multivariate t of so many degrees of freedom, since text statistics have heavy tails; rejected: beyond this quantile of them.
FREEDOM, QUANTILE = 5, 0.999
#: Rows for each dimension that a group needs for an estimate of its own.
LEAST = 3
#: Different rows that one task solves at once.
CHUNK = 4096
#: Large groups that one series of passes takes; others follow in the next.
GROUPS = 10_000
#: Tasks whose sums one task adds.
FAN_IN = 256
#: Starts of a chunk, of which so many go on after two steps.
STARTS, GO_ON = 8, 2
#: C-steps at most, and the gain of the logarithm of the determinant below which they end.
STEPS, SAME = 40, 1e-9
#: Bins of the squared distance for each doubling.
FINE = 64
#: Components of large groups are whole numbers of up to so many bits, their sums pairs of words of HALF bits and the rest.
BITS, HALF = 25, 30
MIN_WORDS = 20
MAX_REPEATED = 30
SEED = 4


@cache
def reference(k: int, quantile: float, freedom: int = FREEDOM) -> float:
    """Quantile of the squared distance of a multivariate t vector of k dimensions: k times that of F(k, freedom)."""
    a, b = k / 2, freedom / 2
    x = np.linspace(0, 1, 200_001)[1:-1]  # of the beta variable k F / (freedom + k F)
    pdf = np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x) + lgamma(a + b) - lgamma(a) - lgamma(b))
    cdf = np.cumsum(pdf) * (x[1] - x[0])
    y = float(np.interp(quantile, cdf, x))
    return freedom * y / (1 - y)


def subset_size(n: int, k: int, share: float = SHARE) -> int:
    """Rows of n that an estimate rests on."""
    return min(n, max(int(np.ceil(n * share)), (n + k + 1) // 2))


def moments(x: np.ndarray, w: np.ndarray, ridge: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, inverse of the covariance, logarithm of its determinant, of rows with weights."""
    m = w @ x / w.sum()
    o = x - m
    c = (o * w[:, None]).T @ o / w.sum() + np.diag(ridge)
    return m, np.linalg.inv(c), float(np.linalg.slogdet(c)[1])


def distances(x: np.ndarray, m: np.ndarray, inv: np.ndarray) -> np.ndarray:
    o = x - m
    return ((o @ inv) * o).sum(1)


def median(v: np.ndarray, w: np.ndarray) -> float:
    """Median of values that stand for w rows each: of two middle ones the mean."""
    order = np.argsort(v, kind="stable")
    upto = 2 * np.cumsum(w[order])
    last = len(v) - 1
    return float(v[order[[min(np.searchsorted(upto, upto[-1] // 2, side), last) for side in ("left", "right")]]].mean())


def nearest(d: np.ndarray, w: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that hold the h smallest distances, and how many copies of each count."""
    order = np.argsort(d, kind="stable")
    upto = np.cumsum(w[order])
    n = int(np.searchsorted(upto, h)) + 1
    some = w[order[:n]].astype(float)
    some[-1] -= upto[n - 1] - h
    return order[:n], some


def c_steps(x: np.ndarray, w: np.ndarray, d: np.ndarray, h: int, ridge: np.ndarray, steps: int) -> tuple[float, np.ndarray, np.ndarray]:
    last = np.inf
    for _ in range(steps):
        at, some = nearest(d, w, h)
        m, inv, det = moments(x[at], some, ridge)
        if det > last - SAME:
            break
        last, d = det, distances(x, m, inv)
    return det, m, inv


def solve(x: np.ndarray, floors: np.ndarray, share: float = SHARE, w: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Log determinant, mean and inverse covariance of the best estimate found; x in a fixed order gives the same one.

    Row i stands for w[i] equal ones (one, if w is left out).
    """
    k, ridge, rng = x.shape[1], floors * floors, np.random.default_rng(SEED)
    w = np.ones(len(x), np.int64) if w is None else w
    h = subset_size(int(w.sum()), k, share)
    med = np.array([median(v, w) for v in x.T])
    spread = np.maximum(1.4826 * np.array([median(v, w) for v in np.abs(x - med).T]), floors)
    tries = [(((x - med) / spread) ** 2).sum(1)]
    for _ in range(STARTS - 1):
        at = rng.choice(len(x), min(len(x), k + 1), replace=False)
        m, inv, _ = moments(x[at], np.ones(len(at)), ridge)
        tries.append(distances(x, m, inv))
    begun = sorted((c_steps(x, w, d, h, ridge, 2) for d in tries), key=lambda t: t[0])[:GO_ON]
    return min((c_steps(x, w, distances(x, m, inv), h, ridge, STEPS) for _, m, inv in begun), key=lambda t: t[0])


_PARAMS = "gid string, start int, rows long, det double, mu array<double>, inv array<double>, mid double"


def _params(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 7
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["gid", "start", "rows", "det", "mu", "inv", "mid"])


def _distance(k: int):
    off = [F.col("x")[i] - F.col("mu")[i] for i in range(k)]
    terms = [off[i] * off[j] * F.col("inv")[i * k + j] * (1.0 if i == j else 2.0) for i in range(k) for j in range(i, k)]
    return sum(terms[1:], terms[0])


def whole_numbers(x: np.ndarray, scale: float) -> np.ndarray:
    return np.rint(x * scale).astype(np.int64)


def binned(y: np.ndarray, scale: float, mu: np.ndarray, inv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the squared distance of rows y (whole numbers) that occur, and for each: count, sums of y and of products, the latter two in two words each."""
    k = y.shape[1]
    o = y / scale - mu
    d = np.zeros(len(y))
    for i in range(k):  # one product after another, so that a row's distance is the same in any batch
        for j in range(i, k):
            d += o[:, i] * o[:, j] * (inv[i, j] * (1.0 if i == j else 2.0))
    part, power = np.frexp(np.maximum(d, 0.0) + 1e-9)
    bins = power.astype(np.int64) * FINE + np.floor((2 * part - 1) * FINE).astype(np.int64)
    sums = np.concatenate([np.ones((len(y), 1), np.int64), y, *[y[:, i : i + 1] * y[:, i:] for i in range(k)]], 1)
    bins, sums = fold(bins, sums)
    return bins, np.concatenate([sums[:, :1], sums[:, 1:] >> HALF, sums[:, 1:] & ((1 << HALF) - 1)], 1)


def fold(bins: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row a bin, in order."""
    order = np.argsort(bins, kind="stable")
    bins = bins[order]
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    return bins[first], np.add.reduceat(sums[order], first, axis=0)


def lower_edge(at: int) -> float:
    return float(np.ldexp(0.5 + (at % FINE) / (2 * FINE), at // FINE))


def next_estimate(bins: np.ndarray, sums: np.ndarray, scale: float, floors: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
    """C-step from the bins of all rows of a group: log determinant, mean, inverse covariance; and the median of the distances binned."""
    k = len(floors)
    upto = np.cumsum(sums[:, 0])
    n = int(upto[-1])
    mid = int(np.searchsorted(2 * upto, n))
    into = (n / 2 - (upto[mid] - sums[mid, 0])) / sums[mid, 0]
    middle = lower_edge(bins[mid]) + into * (lower_edge(bins[mid] + 1) - lower_edge(bins[mid]))
    h = subset_size(n, k)
    last = int(np.searchsorted(upto, h))
    of, want = int(sums[last, 0]), h - int(upto[last] - sums[last, 0])  # of the last bin's rows, so many count
    width = (sums.shape[1] - 1) // 2
    whole = lambda v: [(int(hi) << HALF) + int(lo) for hi, lo in zip(v[1 : 1 + width], v[1 + width :], strict=True)]
    total = [of * a + want * b for a, b in zip(whole(sums[:last].sum(0)), whole(sums[last]), strict=True)]
    count, one, two = of * h, total[:k], iter(total[k:])
    cov = np.diag(floors * floors)
    for i in range(k):
        for j in range(i, k):
            v = (count * next(two) - one[i] * one[j]) / (count * count) / scale / scale
            cov[i, j] += v
            cov[j, i] = cov[i, j]
    mean = np.array([v / count / scale for v in one])
    return float(np.linalg.slogdet(cov)[1]), mean, np.linalg.inv(cov), middle


_SUMS = "gid string, task int, bins array<long>, sums array<long>"


def _sums(rows: list[tuple]) -> pa.RecordBatch:
    gid, task, bins, sums = zip(*rows, strict=True) if rows else ((), (), (), ())
    long = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(gid, pa.string()), pa.array(task, pa.int32()), pa.array(bins, long), pa.array([s.reshape(-1) for s in sums], long)], ["gid", "task", "bins", "sums"])


def _added(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    bins = table.column("bins").combine_chunks().flatten().to_numpy()
    return fold(bins, table.column("sums").combine_chunks().flatten().to_numpy().reshape(len(bins), -1))


def _step(mine: DataFrame, now: dict[str, tuple[float, np.ndarray, np.ndarray]], scale: float, floors: np.ndarray) -> dict[str, tuple[float, np.ndarray, np.ndarray, float]]:
    """next_estimate of each group of `now`, in one pass over the rows of mine."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, got = TaskContext.get().partitionId(), {}
        for b in batches:
            names = b.column(0).dictionary_encode()
            at, x = names.indices.to_numpy(), b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            for i, gid in enumerate(names.dictionary.to_pylist()):
                if gid not in now:
                    continue
                y = whole_numbers(x[at == i], scale)
                for lo in range(0, len(y), CHUNK):  # so that no sum passes a word
                    parts = got.setdefault(gid, [])
                    parts.append(binned(y[lo : lo + CHUNK], scale, *now[gid][1:]))
                    if len(parts) > 16:
                        got[gid] = [fold(*(np.concatenate(p) for p in zip(*parts, strict=True)))]
        for gid, parts in got.items():
            yield _sums([(gid, task, *fold(*(np.concatenate(p) for p in zip(*parts, strict=True))))])

    def add(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_sums([(table.column("gid")[0].as_py(), 0, *_added(table))])])

    def close(table: pa.Table) -> pa.Table:
        det, m, inv, mid = next_estimate(*_added(table), scale, floors)
        return pa.Table.from_batches([_params([(table.column("gid")[0].as_py(), 0, 0, det, m.tolist(), inv.reshape(-1).tolist(), mid)])])

    sums = arrow_map(mine, of_task, _SUMS)
    some = sums.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")).groupBy("gid", "task").applyInArrow(add, _SUMS)
    rows = some.groupBy("gid").applyInArrow(close, _PARAMS).collect()  # one for each of at most GROUPS groups or so
    return {r.gid: (r.det, np.array(r.mu), np.array(r.inv).reshape(len(floors), -1), r.mid) for r in rows}


def _large(rows: DataFrame, begun: DataFrame, floors: np.ndarray) -> DataFrame:
    """_PARAMS of the groups in begun (the estimate of the best chunk) after C-steps over all their rows; begun has one row a group."""
    spark = rows.sparkSession
    slices = -(-begun.count() // GROUPS)
    begun = begun.withColumn("slice", F.pmod(F.xxhash64("gid"), F.lit(slices)))
    path = new_path(spark, "mcd-large")
    mine = sized_join(rows.select("gid", "x"), begun.select("gid", "slice"), "gid", "inner")
    mine.sortWithinPartitions("slice", "gid").write.partitionBy("slice").parquet(path)
    mine = spark.read.schema("gid string, x array<double>, slice long").parquet(path)
    most = mine.agg(F.max(F.array_max(F.transform("x", F.abs)))).head()[0]
    scale = float(2.0 ** (BITS - np.ceil(np.log2(max(most, 1e-9)))))
    parts = []
    for s in range(slices):
        now = {r.gid: (np.inf, np.array(r.mu), np.array(r.inv).reshape(len(floors), -1)) for r in begun.filter(F.col("slice") == s).select("gid", "mu", "inv").collect()}
        done = []
        for step in range(STEPS):
            for gid, (det, m, inv, mid) in _step(mine.filter(F.col("slice") == s).select("gid", "x"), now, scale, floors).items():
                was = now[gid]
                if step and (was[0] - det <= SAME or step == STEPS - 1):
                    done.append((gid, 0, 0, was[0], was[1].tolist(), was[2].reshape(-1).tolist(), mid))
                    del now[gid]
                else:
                    now[gid] = det, m, inv
            if not now:
                break
        parts.append(stage(spark.createDataFrame(done, _PARAMS), "mcd-params"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fit_and_score(rows: DataFrame, k: int, floors: list[float], chunk: int = CHUNK) -> DataFrame:
    """rows (gid string, x array<double> of k, any others) with d: the robust squared distance.

    d is scaled so that its median in a group is that of the reference.  It is
    the same however the rows are dealt out.
    """
    prepare(rows.sparkSession)
    least = np.array(floors)
    rows = stage(rows, "mcd-rows")
    unlike = stage(rows.groupBy("gid", "x").agg(F.count("*").alias("w")), "mcd-unlike")  # copies are one row from here on
    sizes = stage(unlike.groupBy("gid").agg(F.sum("w").alias("rows"), F.ceil(F.count("*") / chunk).alias("chunks")), "mcd-groups")
    dealt = sized_join(unlike, sizes, "gid").withColumn("start", F.pmod(F.xxhash64("x"), F.col("chunks")).cast("int"))

    def one(table: pa.Table) -> pa.Table:
        x = table.column("x").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        order = np.lexsort(x.T)
        x, w = x[order], table.column("w").to_numpy()[order]
        det, m, inv = solve(x, least, w=w)
        row = (table.column("gid")[0].as_py(), table.column("start")[0].as_py(), table.column("rows")[0].as_py(), det, m.tolist(), inv.reshape(-1).tolist(), median(distances(x, m, inv), w))
        return pa.Table.from_batches([_params([row])])

    solved = stage(dealt.groupBy("gid", "start").applyInArrow(one, _PARAMS), "mcd-chunks")
    many = sizes.filter("chunks > 1").select("gid")
    params = solved.join(many, "gid", "left_anti")
    if many.head(1):
        begun = sized_join(solved, many, "gid", "left_semi").withColumn("start", F.row_number().over(W.partitionBy("gid").orderBy("det", "start")))
        params = params.unionByName(_large(rows, stage(begun.filter("start = 1"), "mcd-begun"), least))
    params = stage(params.withColumn("mid", F.when(F.col("mid") > 1e-9, F.col("mid")).otherwise(F.lit(reference(k, 0.5)))), "mcd-final")
    scored = sized_join(rows, params.select("gid", "mu", "inv", "mid"), "gid").withColumn("d", _distance(k) / F.col("mid") * F.lit(reference(k, 0.5)))
    return scored.drop("mu", "inv", "mid", "x")


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept.

    Rows that the base rule fails (under 20 words, or over 30 % of the words in
    repeated windows) take no part in the estimates; their distance (squared)
    is null.  A null lang or source is a value like any other; a null text has no
    words.  One row out for each row in.
    """
    k = len(FEATURES)
    st = text_statistics(docs, {"lang": "string", "source": "string"})
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)
    st = st.withColumn("base_failed", failed).withColumn("x", F.array(*[F.col("vec")[RATIOS.index(f)] for f in FEATURES])).drop("vec")
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    st = stage(st.withColumn("lang", name("lang")).withColumn("gid", F.concat_ws("\x1f", "lang", name("source"))).drop("source"), "quality-stats")
    good = st.filter("NOT base_failed")
    sizes = good.groupBy("gid", "lang").count()
    own = F.col("count") >= LEAST * k
    rest = F.sum(F.when(~own, F.col("count")).otherwise(0)).over(W.partitionBy("lang"))
    to = F.when(own, F.col("gid")).when(F.col("rest") >= LEAST * k, F.col("lang")).otherwise(F.lit(""))
    level = stage(sizes.withColumn("rest", rest).select("gid", to.alias("to")), "quality-groups")
    rows = sized_join(good, level, "gid").drop("gid").withColumnRenamed("to", "gid")
    scored = fit_and_score(rows, k, list(FEATURES.values()))
    out = scored.unionByName(st.filter("base_failed").withColumn("d", F.lit(None).cast("double")).select(scored.columns))
    kept = ~F.col("base_failed") & (F.col("d") <= F.lit(reference(k, QUANTILE)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("d").alias("distance"), F.coalesce(kept, F.lit(False)).alias("kept"))
