"""Frontmatter and tags, as expressions on a column of lines or a path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, lines, trim


def _closing(x: Column) -> Column:
    """Lines of a closed frontmatter block at the start of the lines x; 0 without one."""

    def of(trimmed: Column) -> Column:
        close = F.array_position(F.slice(trimmed, F.lit(2), F.greatest(F.size(trimmed), F.lit(1))), "---")
        return F.when((F.get(trimmed, F.lit(0)) == "---") & (close > 0), close + 1).otherwise(F.lit(0)).cast("int")

    return F.when(trim(F.get(x, F.lit(0))) == "---", let(F.transform(x, trim), of)).otherwise(F.lit(0))


#: A closed block at the start, whole lines: one pass, and one probe of each line.
_BLOCK = r"(?sU)\A[^\S\n]*+---[^\S\n]*+\n(?:.*?\n)??[^\S\n]*+---[^\S\n]*+(?:\n|\z)"


def _front(content: Column) -> Column:
    """The lines of the closed block at the start alone, so that the rest of a text isn't cut into lines; one empty line without a block."""
    return lines(F.regexp_extract(content, _BLOCK, 0))


def frontmatter_lines(content: Column) -> Column:
    """How many lines a closed frontmatter block at the start has; 0 without one."""
    return let(_front(content), _closing)


def hidden_lines(content: Column) -> Column:
    """The lines of the content, those of its frontmatter empty, so that line numbers stay."""
    blank = lambda x: let(_closing(x), lambda n: F.when(n == 0, x).otherwise(F.concat(F.array_repeat(F.lit(""), n), F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0))))))
    return let(lines(content), blank)


def hide_frontmatter(content: Column) -> Column:
    return F.array_join(hidden_lines(content), "\n")


def _clean(items: Column) -> Column:
    """Trimmed, unquoted, lower case, without empty ones and repeats."""
    bare = F.transform(items, lambda x: F.lower(F.regexp_replace(trim(x), "^[\"']+|[\"']+$", "")))
    return F.array_distinct(F.filter(bare, lambda x: x != ""))


def parse_tags(content: Column) -> Column:
    """Tags of the first tags: line of the frontmatter, inline or as the list of items that follows it."""
    none = F.array().cast("array<string>")

    def items(after: Column) -> Column:
        ends = F.array_position(F.transform(after, lambda x: F.startswith(x, F.lit("- "))), False)
        many = F.when(ends > 0, F.slice(after, F.lit(1), F.greatest(ends - 1, F.lit(0)).cast("int"))).otherwise(after)
        return F.transform(many, lambda x: F.substring(x, 3, 1 << 30))

    def at_line(block: Column, at: Column) -> Column:
        rest = trim(F.substring(F.get(block, (at - 1).cast("int")), 6, 1 << 30))
        inline = F.split(F.regexp_replace(rest, r"^[\[\]]+|[\[\]]+$", ""), ",", -1)
        after = F.slice(block, (at + 1).cast("int"), F.size(block))
        return _clean(F.when(rest == "", let(after, items)).otherwise(inline))

    def in_block(block: Column) -> Column:
        at = F.array_position(F.transform(block, lambda x: F.startswith(x, F.lit("tags:"))), True)
        return let(at, lambda a: F.when(a > 0, at_line(block, a)).otherwise(none))

    def of(x: Column) -> Column:
        return let(_closing(x), lambda n: F.when(n > 2, let(F.transform(F.slice(x, F.lit(2), F.greatest(n - 2, F.lit(0))), trim), in_block)).otherwise(none))

    return let(_front(content), of)


def auto_tags(path: Column) -> Column:
    """Folders of the path and its extension, lower case."""
    parts = F.split(path, "/", -1)
    folders = F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda x: x != "")
    ext = F.regexp_extract(F.element_at(parts, -1), r"(?s)^.+\.([^.]+)$", 1)
    return F.transform(F.concat(folders, F.when(ext == "", F.array().cast("array<string>")).otherwise(F.array(ext))), F.lower)


def merged_tags(content: Column, path: Column) -> Column:
    return F.array_distinct(F.concat(parse_tags(content), auto_tags(path)))


def with_frontmatter(content: Column, tags: Column) -> Column:
    """The content under a block with the tags; as it is without tags, or if it starts with --- already."""
    block = F.concat(F.lit("---\ntags: ["), F.array_join(tags, ", "), F.lit("]\n---\n"), content)
    return F.when((F.size(tags) == 0) | F.startswith(content, F.lit("---")), content).otherwise(block)
