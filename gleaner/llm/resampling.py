"""Importance resampling towards a target: draw the documents that look most like it, with exact ranks.

Words are hashed into buckets; a bucket's gain is the log ratio of its shares in
the target and in the corpus, and a document's weight is the mean gain of its
words, read from an array.  A Gumbel draw of the doc_id is added, so that the
highest scores are a sample without replacement.  The rows that may be drawn lie in runs,
one a partition, sorted and stored in the shared folder; each range of scores
is merged from its part of all runs by a tournament tree, which stops after the
range's share of the draw.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, only, stage, strings

BUCKETS = 10_000
#: Words in a feature, at most.
LONGEST = 1
MIN_WORDS = 20
#: Drawn, in hundredths of the documents with MIN_WORDS words.
PERCENT = 10
SEED = "2024"
#: Rows that one merge takes, about; rows with one score stay together.
RANGE_ROWS = 100_000
#: Buckets of words that a worker remembers.
REMEMBERED = 500_000
#: Runs of ASCII digits, ASCII letters and whatever lies beyond ASCII, in lower-cased bytes.
_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Buckets(dict):
    """The bucket of a feature."""

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[feature] = bucket = zlib.crc32(feature) % BUCKETS
        return bucket


def features(text: str, longest: int = LONGEST) -> tuple[int, list[bytes]]:
    """How many words a text has, and all runs of 1 to `longest` of them."""
    words = _WORDS.findall(text.encode().lower())  # bytes: only A to Z change
    runs = words if longest == 1 else [b" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
    return len(words), runs


def noise(doc_id: int | None) -> int:
    """A thousandth of a Gumbel draw is the unit; a null doc_id is hashed as no digits."""
    h = int(hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def bucket_counts(texts: DataFrame, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts fall into each bucket; tasks and the driver get BUCKETS rows each at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, bucket = np.zeros(BUCKETS, np.int64), Buckets()
        for b in batches:
            for t in strings(b.column(0)):
                found = features(t, longest)[1]
                total += np.bincount(np.fromiter(map(bucket.__getitem__, found), np.int64, len(found)), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at), "n": pa.array(total[at])})

    out = np.zeros(BUCKETS, np.int64)
    for r in arrow_map(only(texts, text="string"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, floored."""
    s_all, t_all = float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + BUCKETS) / ((s + 1) * (t_all + BUCKETS)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def score_documents(docs: DataFrame, target: DataFrame, longest: int = LONGEST) -> DataFrame:
    """rid, doc_id, n_words, n_features, weight, score for every row of docs, staged."""
    gain = gains(bucket_counts(docs, longest), bucket_counts(target, longest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Buckets()
        for b in batches:
            rows = []
            for doc_id, t in zip(b.column(1).to_pylist(), strings(b.column(2)), strict=True):
                n, found = features(t, longest)
                m = len(found)
                weight = int(gain[np.fromiter(map(bucket.__getitem__, found), np.int64, m)].sum()) // m if m else 0
                rows.append((n, m, weight, weight + noise(doc_id)))
            cols = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["rid", "doc_id", "n_words", "n_features", "weight", "score"])

    rows = only(docs, doc_id="long", text="string").select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    return stage(arrow_map(rows, run, "rid long, doc_id long, n_words long, n_features long, weight long, score long"), "resampling-scores")


class Tournament:
    """Merges sorted runs: each inner node of the tree holds the loser of the match there, so a step replays one path."""

    END = (math.inf,)

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.heads = [next(r, self.END) for r in runs]
        k = len(runs)
        self.losers = [0] * k
        winner = [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            if self.heads[b] < self.heads[a]:
                a, b = b, a
            winner[node], self.losers[node] = a, b
        self.best = winner[1] if k > 1 else 0

    def __iter__(self) -> Iterator[tuple]:
        k = len(self.runs)
        while k and self.heads[self.best] is not self.END:
            yield self.heads[self.best]
            a = self.best
            self.heads[a] = next(self.runs[a], self.END)
            node = (a + k) // 2
            while node:
                if self.heads[self.losers[node]] < self.heads[a]:
                    a, self.losers[node] = self.losers[node], a
                node //= 2
            self.best = a


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of each range, of batches sorted by range; columns run, score, doc_id, null, rid."""
    held: list[list[np.ndarray]] = []
    at = -1
    for b in batches:
        ids = b.column(5).fill_null((1 << 63) - 1).to_numpy(zero_copy_only=False)
        cols = [b.column(1).to_numpy(), b.column(4).to_numpy(), ids, b.column(5).is_null().to_numpy(zero_copy_only=False), b.column(3).to_numpy()]
        which = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(which)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            if which[lo] != at and held:
                yield at, [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
            at = int(which[lo])
            held.append([c[lo:hi] for c in cols])
    if held:
        yield at, [np.concatenate(x) for x in zip(*held, strict=True)]


def draw(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """rid, rank of the drawn rows: the highest scores, ties to the smaller doc_id (null last), then the smaller rid.

    Scores are whole numbers between about -50,000 and 70,000 (the log ratios of
    counts and the Gumbel draws of 32 bits have bounds), so the count of each score is a
    small table: it gives the lowest score drawn, and the rank at which each range begins.
    """
    spark = scored.sparkSession
    eligible = scored.filter(F.col("n_words") >= min_words)
    counted = sorted(((r["score"], r["count"]) for r in eligible.groupBy("score").count().collect()), reverse=True)
    values, sizes = np.array([c[0] for c in counted], np.int64), np.array([c[1] for c in counted], np.int64)
    take = percent * int(sizes.sum()) // 100
    before = np.cumsum(sizes) - sizes
    values, before = values[before < take], before[before < take]
    which = before // range_rows
    first = {int(r): int(before[i]) for i, r in reversed(list(enumerate(which)))}
    lowest = int(values[-1]) if len(values) else 1 << 62
    rising, ranges = values[::-1].copy(), which[::-1].copy()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = ranges[np.searchsorted(rising, b.column(3).to_numpy())] if b.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *b.columns], ["range", "run", "place", "rid", "score", "doc_id"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, (run, score, doc_id, null, rid) in _ranges(batches):
            cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(run)]
            keys = lambda lo, hi: zip((-score[lo:hi]).tolist(), null[lo:hi].tolist(), doc_id[lo:hi].tolist(), rid[lo:hi].tolist(), strict=True)
            won, begin = [], first[at]
            for key in Tournament([keys(lo, hi) for lo, hi in zip(cuts, cuts[1:], strict=False)]):
                if begin + len(won) == take:
                    break
                won.append(key[3])
            yield pa.RecordBatch.from_pydict({"rid": pa.array(won, pa.int64()), "rank": pa.array(np.arange(begin + 1, begin + 1 + len(won)))})

    runs = eligible.filter(F.col("score") >= lowest).select("rid", "score", "doc_id")
    runs = runs.sortWithinPartitions(F.desc("score"), F.asc_nulls_last("doc_id"), "rid").withColumn("_id", F.monotonically_increasing_id())
    runs = runs.select(F.shiftright("_id", 33).alias("run"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"), "rid", "score", "doc_id")
    runs = stage(runs, "resampling-runs")
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), len(first)) or 1
    dealt = arrow_map(runs, place, "range long, run long, place long, rid long, score long, doc_id long")
    dealt = dealt.repartition(parts, "range").sortWithinPartitions("range", "run", "place")
    return arrow_map(dealt, merge, "rid long, rank long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn) for every row of docs.

    docs: doc_id, text; target: text.  Null texts are empty and have weight 0;
    rows that repeat a doc_id are rows of their own.  Empty tables count nothing.
    """
    scored = score_documents(docs, target, longest)
    ranks = draw(scored, percent, min_words)
    return scored.join(ranks, "rid", "left").select("doc_id", "n_features", "weight", "score", "rank")


#: Resampling in DuckDB.  CRC-32 is reckoned byte by byte, for each different word.
RESAMPLING_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) r(i)
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), s0 AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM d) GROUP BY w
), t0 AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM b) GROUP BY w
), v AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda h: CAST('0x' || h AS BIGINT))),
                            lambda c, x: xor(c >> 8, crc[CAST(xor(c & 255, x) AS INTEGER) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT w FROM s0 UNION SELECT w FROM t0), tab
), s AS (SELECT bucket, sum(n) AS n FROM s0 JOIN v USING (w) GROUP BY bucket
), t AS (SELECT bucket, sum(n) AS n FROM t0 JOIN v USING (w) GROUP BY bucket
), g AS (
  SELECT v.w, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM s), 0) + 10000)::DOUBLE
                                   / ((coalesce(s.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM v LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
), u AS (SELECT rid, count(*) AS n, sum(gain) AS gains FROM (SELECT rid, unnest(w) AS w FROM d) JOIN g USING (w) GROUP BY rid
), x AS (
  SELECT rid, doc_id, len(w) AS n_features, coalesce(CAST((gains - ((gains % n) + n) % n) // n AS BIGINT), 0) AS weight,
         CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS h
  FROM d LEFT JOIN u USING (rid)
), y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM x
), r AS (
  SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, rid) AS rank, count(*) OVER () AS n FROM y WHERE n_features >= 20
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN CAST(rank AS BIGINT) END AS rank FROM y LEFT JOIN r USING (rid)
"""
