"""Hits as JSON or as lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hit_json(hits: DataFrame) -> Column:
    """One JSON object for a row; empty heading, false flags and nulls are left out."""
    cols = [c for c in ("doc", "para", "lines", "score", "snippet", "heading", "stale", "body", "body_truncated") if c in hits.columns]
    value = {c: F.nullif(F.col(c), F.lit("")) if c == "heading" else F.when(F.col(c), True) if c in ("stale", "body_truncated") else F.col(c) for c in cols}
    return F.to_json(F.struct(*[v.alias(c) for c, v in value.items()]))


def json_array(objects: list[str]) -> str:
    """Objects as one JSON array; what HTML would read as markup is escaped."""
    return "[" + ",".join(objects).replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026") + "]"


def hit_lines(hits: DataFrame) -> Column:
    """doc#para (lines a-b, score 0.0000)[ [stale]][ | heading], and the snippet on a line of its own."""
    stale = F.when(F.col("stale"), " [stale]").otherwise("") if "stale" in hits.columns else F.lit("")
    heading = F.when(F.coalesce("heading", F.lit("")) != "", F.concat(F.lit(" | "), F.col("heading"))).otherwise("")
    return F.concat(F.format_string("%s#%d (lines %s, score %.4f)", F.col("doc"), F.col("para"), F.col("lines"), F.col("score")), stale, heading, F.lit("\n  "), F.col("snippet"))
