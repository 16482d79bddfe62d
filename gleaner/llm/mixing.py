"""Mixing sources to target weights on a time-varying curriculum.

Targets are filled like communicating vessels: each source gets the common
level times its weight, held to CAP times what it has.  Each source has a
schedule, a piecewise linear weight over training time, whose integral is its
cumulative token demand.  The documents of a source form a stream of words in an
order drawn from doc_id; inverting the cumulative demand at a document's place
in that stream gives its training time, and the demand of all sources up to then
its position in words.  What has a position is in the mix; it is range-sorted by
position, which gives training ranks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, global_order, sized_join, stage

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Of all sizes, the share that the mix has; and the most it takes of a source.
SIZE, CAP = 1.5, 2
#: (training time, weight) of each schedule, linear between them, by the source's rank, repeating: even, late to fall, ever faster rising.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (0.5, 1.5), (1.0, 0.5)), ((0.0, 0.5), (0.5, 1.0), (1.0, 2.5)))


def _by_rank(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (rank % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """key, source_size, target, rank from (key, source_size); keys sort as the sources do.

    The level is the greatest of (budget - caps of the sources that fill up
    earlier) / (weights of the others): below it a source is full, above it not.
    """
    one = W.orderBy("key")
    s = sizes.withColumn("rank", (F.row_number().over(one) - 1).cast("int")).withColumn("w", _by_rank(WEIGHTS, F.col("rank")).cast("long"))
    full = W.orderBy((F.col("source_size") * (F.lit(6) / F.col("w")).cast("long")), "key")  # by size / weight, in whole numbers
    before, on = full.rowsBetween(W.unboundedPreceding, -1), full.rowsBetween(0, W.unboundedFollowing)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(every))
    level = (F.col("total") * F.lit(SIZE) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(CAP)) / F.sum("w").over(on)
    s = s.withColumn("lv", level).withColumn("level", F.max("lv").over(every))
    target = F.least((F.col("source_size") * CAP).cast("double"), F.col("level") * F.col("w"))
    return s.select("key", "source_size", "rank", target.alias("target"))


def segments(schedule: tuple) -> list[tuple[float, float, float, float, float, float]]:
    """(start, end, weight at the start, slope, integral before, integral up to the end) of each part; the whole integral is 1."""
    total = sum((y - x) * (a + b) / 2 for (x, a), (y, b) in zip(schedule, schedule[1:], strict=False))
    out, done = [], 0.0
    for (x, a), (y, b) in zip(schedule, schedule[1:], strict=False):
        a, b = a / total, b / total
        area = (y - x) * (a + b) / 2
        out.append((x, y, a, (b - a) / (y - x), done, done + area))
        done += area
    return out


def _sql_time(schedule: tuple, share: str) -> str:
    """The training time by which `share` of the demand is met: the integral, inverted part by part."""
    parts = segments(schedule)
    each = [f"({x!r} + " + (f"({share} - {done!r}) / {a!r})" if s == 0 else f"(sqrt({a * a!r} + {2 * s!r} * ({share} - {done!r})) - {a!r}) / {s!r})") for x, _, a, s, done, _ in parts]
    return "CASE " + "".join(f"WHEN {share} <= {p[5]!r} THEN {e} " for p, e in zip(parts[:-1], each, strict=False)) + f"ELSE {each[-1]} END" if parts[1:] else each[0]


def _sql_demand(schedule: tuple, time: str) -> str:
    """The share of its demand that a source has met by a training time."""
    parts = segments(schedule)
    each = [f"({done!r} + ({time} - {x!r}) * ({a!r} + {s / 2!r} * ({time} - {x!r})))" for x, _, a, s, done, _ in parts]
    return "CASE " + "".join(f"WHEN {time} <= {p[1]!r} THEN {e} " for p, e in zip(parts[:-1], each, strict=False)) + f"ELSE {each[-1]} END" if parts[1:] else each[0]


def sql_position(share: str, rank: str, demands: list[str]) -> tuple[str, str]:
    """SQL, for Spark and others, of the training time, and (of a column `time`) of the position in words.

    demands: the words that all sources with the first, second, ... schedule have together.
    """
    time = "CASE " + "".join(f"WHEN {rank} % {len(SCHEDULES)} = {k} THEN {_sql_time(s, share)} " for k, s in enumerate(SCHEDULES)) + "END"
    return time, " + ".join(f"{d} * ({_sql_demand(s, 'time')})" for d, s in zip(demands, SCHEDULES, strict=True))


def _double(sql: str) -> str:
    """Every number in it as a double: SQL reads 0.5 as a decimal."""
    return re.sub(r"(?<![\w.])(\d+\.\d+(?:e-?\d+)?)", r"CAST('\1' AS DOUBLE)", sql)


def _rows(docs: DataFrame) -> DataFrame:
    """docs with what identifies a row's part in the mix: key (of its source), size, h (of its text), draw."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("~"))  # '=' sorts before '~'
    return docs.withColumns({"_id": F.col("doc_id").cast("long"), "_key": key, "_size": size, "_h": F.xxhash64("text")})


def place_documents(docs: DataFrame) -> DataFrame:
    """A row for each pass over a document, and one for each document without any.

    doc_id, key, size, h, source_size, target, rid (of the row of docs), pass (0
    or 1), n (words taken in it), position (words of the mix by then, expected;
    null if there is no pass), and _part, _at: the order by position (null if none).
    """
    draw = F.md5(F.coalesce(F.col("_id").cast("string"), F.col("text"), F.lit("")))
    rows = stage(_rows(docs).select(F.col("_id").alias("doc_id"), F.col("_key").alias("key"), F.col("_size").alias("size"), F.col("_h").alias("h"), draw.alias("draw")), "mix-sizes")
    sources = source_targets(rows.groupBy("key").agg(F.sum("size").alias("source_size")))
    sources = stage(sources.withColumn("whole", F.round("target").cast("long")), "mix-targets")
    kinds = F.array(*[F.coalesce(F.sum(F.when(F.col("rank") % len(SCHEDULES) == k, F.col("whole"))), F.lit(0)) for k in range(len(SCHEDULES))])
    kinds = sources.agg(kinds.alias("x")).head()[0]  # one row
    placed, _ = global_order(rows, ["key", "draw", "doc_id", "size", "h"], "mix-order")
    parts = placed.groupBy("_part", "key").agg(F.sum("size").alias("n"))
    w = W.partitionBy("key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = stage(parts.select(F.concat_ws("\x1f", F.col("_part").cast("string"), "key").alias("_pk"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_off")), "mix-parts")
    run = W.partitionBy("_part", "key").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("_in", F.coalesce(F.sum("size").over(run), F.lit(0))).withColumn("_pk", F.concat_ws("\x1f", F.col("_part").cast("string"), "key"))
    placed = sized_join(placed, parts, "_pk").withColumn("place", F.col("_in") + F.col("_off"))
    placed = sized_join(placed, sources, "key")
    rid = F.shiftleft(F.col("_part").cast("long"), 33).bitwiseOR(F.col("_at"))
    starts = F.array(*[F.struct(F.lit(k).alias("pass"), (F.col("place") + k * F.col("source_size")).alias("start")) for k in range(CAP)])
    passes = F.filter(starts, lambda x: (x["start"] < F.col("whole")) & (F.col("size") > 0))
    out = placed.withColumn("rid", rid).withColumn("_x", F.explode_outer(passes)).select("doc_id", "key", "size", "h", "source_size", "target", "whole", "rank", "rid", "_x.pass", "_x.start")
    time, position = (_double(x) for x in sql_position("share", "rank", [f"CAST({n} AS DOUBLE)" for n in kinds]))
    out = out.withColumn("share", F.col("start").cast("double") / F.col("whole").cast("double")).withColumn("time", F.expr(time)).withColumn("position", F.expr(position))
    out = out.withColumn("n", F.when(F.col("start").isNull(), 0).otherwise(F.least(F.col("size"), F.col("whole") - F.col("start"))).cast("long")).drop("whole", "rank", "share", "time")
    none = stage(out.filter("position IS NULL"), "mix-rest").select("*", F.lit(None).cast("long").alias("_part"), F.lit(None).cast("long").alias("_at"))
    return global_order(out.filter("position IS NOT NULL"), ["position", "key", "start"], "mix-positions")[0].unionByName(none)


def plan_mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, position, again, rank, rank_again for every row of docs.

    size: words of the text (null: 0).  taken: the words that the mix takes,
    repeats counted: whole documents, except at the end of a source's target,
    so a source's taken words are its target rounded to a whole number.
    position, again: where in the mix, in words, the first and the second pass
    over the document are due, and rank, rank_again their places (from 1) in
    training order; null where there is no such pass.  A null source is one
    source, after all others; null doc_ids are told apart by their texts, rows
    with the same doc_id lie next to each other.  Documents without words take no
    part.  One row out for each row in; reruns agree.
    """
    passes = place_documents(docs)
    counts = passes.filter("position IS NOT NULL").groupBy("_part").count().orderBy("_part").collect()  # a row for each partition
    starts, done = [], 0
    for r in counts:
        starts.append((r["_part"], done))
        done += r["count"]
    starts = docs.sparkSession.createDataFrame(starts, "_part long, _off long")
    passes = passes.withColumn("_part", F.col("_part").cast("long")).join(F.broadcast(starts), "_part", "left")
    first, second = F.col("pass") == 0, F.col("pass") == 1
    rank = F.when(F.col("position").isNotNull(), F.col("_off") + F.col("_at") + 1)
    one = lambda c, where: F.max(F.when(where, c))
    return passes.groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.sum("n").alias("taken"), one(F.col("position"), first).alias("position"), one(F.col("position"), second).alias("again"),
        one(rank, first).alias("rank"), one(rank, second).alias("rank_again"),
    ).drop("rid")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of docs (their columns), once for each pass, range-sorted by training position.

    Of a document that is taken in part, the first words that are taken remain,
    joined by one blank.  Rows equal in doc_id, source and text stand for each
    other: the columns of one of them may come with the passes of all.
    """
    same = ["_id", "_key", "_size", "_h"]
    passes = place_documents(docs).filter("n > 0")
    passes = passes.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("size").alias("_size"), F.col("h").alias("_h"), "n", "position", "start", "pass")
    rows = _rows(docs)
    if passes.filter("pass = 0").groupBy(*same).count().filter("count > 1").head(1):  # else each is one row
        rows = rows.dropDuplicates(same)
    on = [F.col(f"p.{c}").eqNullSafe(F.col(f"d.{c}")) for c in same]
    both = rows.alias("d").join(passes.alias("p"), on[0] & on[1] & on[2] & on[3]).select("d.*", "p.n", "p.position", "p.start")
    text = F.when(F.col("n") < F.col("_size"), F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), 1), 1, F.col("n").cast("int")), " ")).otherwise(F.col("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns], F.col("position").alias("_p"), F.col("_key").alias("_k"), F.col("start").alias("_s"))
    return both.repartitionByRange(parts, "_p", "_k", "_s").sortWithinPartitions("_p", "_k", "_s").drop("_p", "_k", "_s")


_TIME, _POSITION = (_double(x) for x in sql_position("share", "rank", ["CAST(k0 AS DOUBLE)", "CAST(k1 AS DOUBLE)", "CAST(k2 AS DOUBLE)"]))
#: The plan of the mix in DuckDB.
PLAN_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '~') AS key, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS draw, row_number() OVER () AS rid
  FROM documents
), s AS (
  SELECT key, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY key
), r AS (
  SELECT *, row_number() OVER (ORDER BY key) - 1 AS rank FROM s
), w AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM r
), l AS (
  SELECT *, (CAST(total AS DOUBLE) * 1.5 - CAST(2 * coalesce(sum(source_size) OVER (ORDER BY source_size * (6 // w), key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
            / CAST(sum(w) OVER (ORDER BY source_size * (6 // w), key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lv FROM w
), t0 AS (
  SELECT key, source_size, rank, least(CAST(2 * source_size AS DOUBLE), (max(lv) OVER ()) * w) AS target FROM l
), t AS (
  SELECT *, CAST(round(target) AS BIGINT) AS whole FROM t0
), k AS (
  SELECT coalesce(sum(whole) FILTER (rank % 3 = 0), 0) AS k0, coalesce(sum(whole) FILTER (rank % 3 = 1), 0) AS k1, coalesce(sum(whole) FILTER (rank % 3 = 2), 0) AS k2 FROM t
), c AS (
  SELECT d.*, CAST(coalesce(sum(size) OVER (PARTITION BY key ORDER BY draw, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place FROM d
), p0 AS (
  SELECT c.*, source_size, target, whole, rank, pass, place + pass * source_size AS start FROM c JOIN t USING (key), (VALUES (0), (1)) v(pass)
), p1 AS (
  SELECT *, CAST(start AS DOUBLE) / CAST(whole AS DOUBLE) AS share FROM p0 WHERE size > 0 AND start < whole
), p2 AS (SELECT *, {_TIME} AS time FROM p1), p3 AS (SELECT *, {_POSITION} AS position FROM p2, k
), p AS (
  SELECT *, least(size, whole - start) AS n, row_number() OVER (ORDER BY position, key, start) AS r FROM p3
), a AS (
  SELECT rid, sum(n) AS n, max(position) FILTER (pass = 0) AS p0, max(position) FILTER (pass = 1) AS p1, max(r) FILTER (pass = 0) AS r0, max(r) FILTER (pass = 1) AS r1 FROM p GROUP BY rid
)
SELECT doc_id, size, source_size, target, CAST(coalesce(n, 0) AS BIGINT) AS taken, round(p0, 6) AS position, round(p1, 6) AS again, CAST(r0 AS BIGINT) AS rank, CAST(r1 AS BIGINT) AS rank_again
FROM c JOIN t USING (key) LEFT JOIN a USING (rid)
"""
