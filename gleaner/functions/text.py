"""Text column functions.  White space is Unicode's White_Space everywhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefix of what is hashed: the version of the index, and a NUL.
HASH_VERSION = "v4"
SNIPPET_CHARS = 120
_SPACE = r"(?U)\s+"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once: within f, and in lambdas there, it is a variable."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def content_hash(content: Column) -> Column:
    """Hex SHA-256 of the version, a NUL and the content."""
    return F.sha2(F.concat(F.lit(HASH_VERSION).cast("binary"), F.unhex(F.lit("00")), content.cast("binary")), 256)


def normalize_newlines(content: Column) -> Column:
    """CRLF becomes LF; a lone CR stays."""
    return F.replace(content, F.lit("\r\n"), F.lit("\n"))


def lines(content: Column) -> Column:
    """All lines, empty ones at the end too."""
    return F.split(normalize_newlines(content), "\n", -1)


def trim(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s++|(?<!\s)\s++$", "")  # each run of blanks is read once


def fold(s: Column) -> Column:
    return F.lower(s)


def words(query: Column) -> Column:
    """The words of a query; none for a blank one."""
    return F.filter(F.split(query, _SPACE), lambda w: w != "")


def fts_query(query: Column) -> Column:
    """Each word as a quoted phrase, any of which may match."""
    return F.array_join(F.transform(words(query), lambda w: F.concat(F.lit('"'), F.replace(w, F.lit('"'), F.lit('""')), F.lit('"'))), " OR ")


def snippet(text: Column) -> Column:
    """On one line; over 120 code points, the first 120 and an ellipsis."""
    one = F.trim(F.regexp_replace(text, _SPACE, " "))
    return F.when(F.length(one) > SNIPPET_CHARS, F.concat(F.substring(one, 1, SNIPPET_CHARS), F.lit("…"))).otherwise(one)


def line_label(start: Column, end: Column) -> Column:
    return F.concat_ws("-", start.cast("string"), end.cast("string"))


def embed_text(heading: Column, text: Column) -> Column:
    """What is embedded for a paragraph."""
    title = F.when(F.coalesce(heading, F.lit("")) == "", F.lit("none")).otherwise(heading)
    return F.concat(F.lit("title: "), title, F.lit(" | text: "), text)


def embed_query(query: Column) -> Column:
    """What is embedded for a query."""
    return F.concat(F.lit("task: search result | query: "), query)


def trigrams(text: Column) -> Column:
    """How many trigrams the text has."""
    return F.greatest(F.lit(0), F.length(text) - 2)


def is_absolute_key(path: Column) -> Column:
    return path.rlike(r"^(/|[A-Za-z]:[/\\])")


def score_from_rank(rank: Column) -> Column:
    """1 for the first, rank counted from 1."""
    return F.lit(1.0) / rank


def score_from_distance(distance: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + distance)
