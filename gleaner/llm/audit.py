"""Filter interaction audit: what each filter removes, in every order of filters.

The orders form a trie of prefixes.  What is left after a prefix depends on the
set of its filters alone, so prefixes with one set share a state: the trie is walked
depth first, each state's survivors are a DataFrame that is persisted while the
walk is below it, and a state met before isn't entered again.  At each edge (a
state and one more filter) the rows that the filter removes from the survivors are counted.
Five filters have 120 orders of 5 steps, 32 states and 80 edges.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, new_path, only, stage, strings

FILTERS = "ABCDE"
MIN_WORDS = 200
#: B fails below this share of distinct words, C above this share of capitals, in hundredths.
DISTINCT, CAPITALS = 50, 3
_MARKS = re.compile(rb"[#$%&*|]")
_UPPER = bytes(range(65, 91))
_COUNTS = ["kept", "removed", "good_lost", "toxic_lost"]


def failures(text: str) -> tuple[bool, bool, bool, bool]:
    """Whether a text fails A, B, C, D."""
    data = text.encode()
    words = data.split()
    n = len(words)
    capitals = len(data) - len(data.translate(None, _UPPER))
    return n < MIN_WORDS, 100 * len(set(words)) < DISTINCT * n, 100 * capitals > CAPITALS * len(text), bool(_MARKS.search(data))


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E (boolean: fails), good, toxic (boolean) for every row of docs.

    part is lang, null as the empty string; null texts are empty ones.  A row
    fails E if a row with a smaller doc_id has the same text (by SHA-256); a null doc_id is
    neither smaller nor larger than any.  good and toxic: some label of the
    doc_id has quality or toxic 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = strings(b.column(1))
            fails = list(zip(*map(failures, texts), strict=True)) if texts else [[]] * 4
            digests = [hashlib.sha256(t.encode()).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *[pa.array(x, pa.bool_()) for x in fails], pa.array(digests, pa.binary())], ["doc_id", "part", *"ABCD", "digest"])

    rows = only(docs, doc_id="long", text="string", lang="string").withColumn("lang", F.coalesce("lang", F.lit("")))
    rows = stage(arrow_map(rows, run, "doc_id long, part string, A boolean, B boolean, C boolean, D boolean, digest binary"), "audit-rows")
    first = stage(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "audit-repeated")
    marks = only(labels, doc_id="long", quality="int", toxic="int").dropna(subset=["doc_id"])
    marks = marks.groupBy("doc_id").agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))])
    both = rows.join(first, "digest", "left").join(marks, "doc_id", "left")
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")]
    return stage(both.select("part", *"ABCD", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E"), *flags), "audit-verdicts")


def _edges(survivors: DataFrame, state: str, filters: str) -> DataFrame:
    """part, state, filter and counts of what each filter outside the state removes from the survivors."""
    rest = [f for f in filters if f not in state]
    n = lambda c: F.count_if(c)
    sums = [x for f in rest for x in (n(F.col(f)).alias(f), n(F.col(f) & F.col("good")).alias(f"g{f}"), n(F.col(f) & F.col("toxic")).alias(f"t{f}"))]
    by_part = survivors.groupBy("part").agg(F.count("*").alias("n"), *sums)
    one = [F.struct(F.lit(f).alias("filter"), (F.col("n") - F.col(f)).alias("kept"), F.col(f).alias("removed"), F.col(f"g{f}").alias("good_lost"), F.col(f"t{f}").alias("toxic_lost")) for f in rest]
    return by_part.select("part", F.lit(state).alias("state"), F.inline(F.array(*one)))


def walk(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, state, filter, kept, removed, good_lost, toxic_lost: a row for each edge and each part that has survivors there.

    rows: part, good, toxic, and a boolean column for each filter (of one
    letter); a stored table, so that survivors lost with an executor are made again.
    """
    path = new_path(rows.sparkSession, "audit-edges")
    seen: set[str] = set()

    def visit(state: str, survivors: DataFrame) -> None:
        seen.add(state)
        _edges(survivors, state, filters).write.mode("append").parquet(path)
        for f in filters:
            below = "".join(x for x in filters if x in state or x == f)
            if below == state or below in seen or len(below) == len(filters):
                continue
            left = survivors.filter(~F.col(f)).persist(StorageLevel.MEMORY_AND_DISK)
            visit(below, left)
            left.unpersist()

    visit("", rows)
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return rows.sparkSession.read.schema(f"part string, state string, filter string, {counts}").parquet(path)


def audit(docs: DataFrame, labels: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step, with kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    An empty table of documents has no parts and no rows.
    """
    spark = docs.sparkSession
    rows = verdicts(docs, labels)
    edges = walk(rows, filters)
    others = {f: [x for x in filters if x != f] for f in filters}
    alone = {f: F.col(f) & ~F.greatest(*[F.col(x) for x in o]) if len(o) > 1 else F.col(f) & ~F.col(o[0]) for f, o in others.items()}
    by_part = rows.groupBy("part").agg(*[x for f in filters for x in (F.count_if(F.col(f)).alias(f), F.count_if(alone[f]).alias(f"u{f}"))])
    every = [("".join(o), i + 1, o[i], "".join(x for x in filters if x in o[:i])) for o in permutations(filters) for i in range(len(filters))]
    places = sorted({x[2:] for x in every})
    at = F.array(*[F.struct(F.lit(f).alias("filter"), F.lit(s).alias("state"), F.col(f).alias("fails"), F.col(f"u{f}").alias("unique_fails")) for f, s in places])
    filled = by_part.select("part", F.inline(at)).join(edges, ["part", "state", "filter"], "left")
    filled = filled.fillna(0, _COUNTS).withColumn("redundant", F.col("fails") - F.col("removed"))
    ways = {s: factorial(len(s)) * factorial(len(filters) - 1 - len(s)) for _, s in places}
    weight = F.create_map(*[F.lit(x) for kv in ways.items() for x in kv])[F.col("state")]
    shapley = filled.groupBy("part", "filter").agg(F.sum(F.col("removed") * weight).alias("shapley"))
    orders = spark.createDataFrame(every, "filter_order string, step int, filter string, state string")
    out = filled.join(shapley, ["part", "filter"]).join(F.broadcast(orders), ["filter", "state"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


#: The audit in DuckDB: rows are counted by the set of filters that they fail.
AUDIT_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS part, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), v AS (
  SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM d LEFT JOIN l USING (doc_id)
), m AS (
  SELECT part, concat(CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END) AS fails,
         count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM v GROUP BY ALL
), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT concat(p.x, q.x, r.x, s.x, t.x) AS filter_order FROM f p, f q, f r, f s, f t
  WHERE p.x NOT IN (q.x, r.x, s.x, t.x) AND q.x NOT IN (r.x, s.x, t.x) AND r.x NOT IN (s.x, t.x) AND s.x <> t.x
), k AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS x, filter_order[1:step - 1] AS before FROM o, range(1, 6) r(step)
), c AS (
  SELECT part, filter_order, step, x, contains(fails, x) AS hit, before <> '' AND regexp_matches(fails, '[' || before || '!]') AS gone, fails, n, good, toxic FROM k, m
), s AS (
  SELECT part, filter_order, step, x,
         coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND hit), 0) AS removed, coalesce(sum(n) FILTER (gone AND hit), 0) AS redundant,
         coalesce(sum(n) FILTER (fails = x), 0) AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND hit), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND hit), 0) AS toxic_lost
  FROM c GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM s
"""
