"""From ranked paragraph ids to hits, bodies, contexts, line ranges and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import line_label, lines, snippet

#: Paragraphs of a document in one band, at least.
BAND = 64


def hydrate(ranking: DataFrame, paras: DataFrame) -> DataFrame:
    """query_id, rank, score, doc, para, lines, snippet, heading (null if empty): one join, after ranking.

    A ranking has k rows a query, so Spark broadcasts it where that is small.
    """
    p = paras.select("para_id", F.col("path").alias("doc"), F.col("seq").alias("para"), line_label(F.col("start_line"), F.col("end_line")).alias("lines"), snippet(F.col("text")).alias("snippet"), F.nullif("heading", F.lit("")).alias("heading"))
    return ranking.join(p, "para_id").select("query_id", "rank", "score", "doc", "para", "lines", "snippet", "heading")


def mark_stale(hits: DataFrame, documents: DataFrame, listing: DataFrame) -> DataFrame:
    """hits with stale: the file is missing or has another mtime (seconds) than the index."""
    indexed = documents.select(F.col("path").alias("doc"), F.col("mtime").alias("_m"))
    found = listing.select(F.col("path").alias("doc"), F.col("mtime").alias("_f"))
    joined = hits.join(indexed, "doc", "left").join(found, "doc", "left")
    return joined.withColumn("stale", F.col("_f").isNull() | ~F.col("_f").eqNullSafe(F.col("_m"))).drop("_m", "_f")


def stale_by(hits: DataFrame, documents: DataFrame, modified: Column) -> DataFrame:
    """hits with stale, from a column with the mtime of a hit's file (null: missing) and the mtimes of the index."""
    indexed = documents.select(F.col("path").alias("doc"), F.col("mtime").alias("_m"))
    return hits.join(indexed, "doc", "left").withColumn("stale", ~modified.eqNullSafe(F.col("_m")) | F.col("_m").isNull()).drop("_m")


def expand_bodies(hits: DataFrame, paras: DataFrame, top: int, budget: int) -> DataFrame:
    """hits with body and body_truncated: paragraph texts of the first `top`, until `budget` code points are used.

    The text that passes the budget is cut there and is the last one.
    """
    if top <= 0 or budget <= 0:
        raise ValueError("top and budget must both be positive")
    texts = paras.select(F.col("path").alias("doc"), F.col("seq").alias("para"), F.col("text").alias("_text"))
    j = hits.join(texts, ["doc", "para"], "left")
    size = F.when(F.col("rank") <= top, F.length("_text")).otherwise(F.lit(0))
    cum = F.sum(size).over(W.partitionBy("query_id").orderBy("rank"))
    j = j.withColumn("_cum", cum).withColumn("_prev", cum - size)
    inside = F.col("rank") <= top
    body = F.when(inside & (F.col("_cum") <= budget), F.col("_text")).when(inside & (F.col("_prev") <= budget), F.substring("_text", F.lit(1), (F.lit(budget) - F.col("_prev")).cast("int")))
    return j.withColumn("body", body).withColumn("body_truncated", inside & (F.col("_prev") <= budget) & (F.col("_cum") > budget)).drop("_text", "_cum", "_prev")


def get_documents(documents: DataFrame, paths: DataFrame) -> DataFrame:
    """path, content of each requested path that exists."""
    return documents.join(paths.select("path").distinct(), "path").select("path", "content")


def get_paragraphs(paras: DataFrame, wanted: DataFrame, context: int = 0) -> DataFrame:
    """path, para, content: for each (path, para) wanted, that paragraph and `context` on both sides, joined by a blank line.

    A wanted paragraph that doesn't exist gives no row.  The paragraphs of a
    document lie in bands, each with `context` more on both sides, and what is wanted of a band
    is cut from it where it lies: a text is shuffled once, or twice at the edge of a band.
    """
    if context < 0:
        raise ValueError("context must not be negative")
    width = max(BAND, 2 * context + 1)
    band = lambda at: F.floor(F.greatest(at, F.lit(0)) / width)
    there = paras.select("path", F.explode(F.sequence(band(F.col("seq") - context), band(F.col("seq") + context))).alias("band"), F.struct("seq", "text").alias("v"), F.lit(None).cast("int").alias("para"))
    asked = wanted.select("path", band(F.col("para")).alias("band"), F.lit(None).cast(there.schema["v"].dataType).alias("v"), F.col("para")).filter("para >= 0")
    both = there.unionByName(asked).groupBy("path", "band").agg(F.sort_array(F.collect_list("v")).alias("x"), F.collect_set("para").alias("para"))
    inside = F.filter("x", lambda v: v["seq"].between(F.col("para") - context, F.col("para") + context))
    out = both.withColumn("para", F.explode("para")).filter(F.exists("x", lambda v: v["seq"] == F.col("para")))
    return out.select("path", "para", F.array_join(F.transform(inside, lambda v: v["text"]), "\n\n").alias("content"))


def get_lines(documents: DataFrame, path: str | None, first: int, last: int) -> DataFrame:
    """path, content: lines first to last (from 1) of one document, or of every one if path is None.

    last is held to the end of the document; a document with fewer than first
    lines gives no row.
    """
    if first < 1 or last < first:
        raise ValueError("line range must be a-b with 1 <= a <= b")
    d = documents if path is None else documents.filter(F.col("path") == path)
    d = d.select("path", lines(F.col("content")).alias("x"))
    return d.filter(F.size("x") >= first).select("path", F.array_join(F.slice("x", first, last - first + 1), "\n").alias("content"))


def get_content(documents: DataFrame, paras: DataFrame, path: str, lines: tuple[int, int] | None = None, para: int | None = None, context: int = 0) -> str | None:
    """Lines before paragraph before whole document; None if there is no such thing."""
    if lines is not None:
        row = get_lines(documents, path, *lines).head()
    elif para is not None:
        if para < 0:
            raise ValueError("paragraph must not be negative")
        spark = documents.sparkSession
        row = get_paragraphs(paras, spark.createDataFrame([(path, para)], "path string, para int"), context).head()
    else:
        row = documents.filter(F.col("path") == path).select("content").head()
    return row["content"] if row else None
