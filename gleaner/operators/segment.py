"""Paragraphs with line numbers and heading breadcrumbs.

Each document is read once, line by line, in Arrow batches and without a
shuffle: folding arrays of lines in expressions takes several times as long, and
quadratic time where there are many headings.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.markup import hide_frontmatter

#: Code points of texts, and paragraphs, that a task gathers before it passes them on (and those of one document more).
GATHERED, PIECES = 2_000_000, 20_000
_HEADING = regex.compile(r"(#{1,6}) (.*)", regex.S)
#: Unicode's White_Space.
_SPACE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def paragraphs_of(content: str) -> list[tuple[int, int, str, str]]:
    """start_line, end_line, text, heading of each paragraph, line by line."""
    out: list[tuple[int, int, str, str]] = []
    block: list[str] = []
    crumbs: list[str] = []
    for i, line in enumerate([*content.replace("\r\n", "\n").split("\n"), ""], 1):
        if not line.strip(_SPACE):
            if block:
                out.append((i - len(block), i - 1, "\n".join(block), " > ".join(crumbs)))
                block = []
            continue
        block.append(line)
        if line[0] == "#" and (m := _HEADING.match(line)) and (title := m[2].strip(_SPACE)):
            crumbs = [*crumbs[: len(m[1]) - 1], title]
    return out


def split_paragraphs(docs: DataFrame, content: str = "content", frontmatter: bool = True) -> DataFrame:
    """The columns of docs but `content`, and seq, start_line, end_line, text, heading: a row for each paragraph.

    seq counts from 0 within a document.  With frontmatter, a closed frontmatter
    block is hidden first.  Null or blank content has no paragraphs.
    """
    keys = [c for c in docs.columns if c != content]
    text = F.coalesce(F.col(content), F.lit(""))
    if frontmatter:
        text = F.when(text.rlike(r"(?U)^\s*---"), hide_frontmatter(text)).otherwise(text)
    tail = (("seq", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("text", pa.string()), ("heading", pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(b: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
            at, *cols = list(zip(*rows, strict=True)) or [()] * 6
            at = pa.array(at, pa.int64())
            return pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns[:-1]), *(pa.array(c, t) for c, (_, t) in zip(cols, tail, strict=True))], [*keys, *(n for n, _ in tail)])

        for b in batches:
            rows, held = [], 0
            for i, t in enumerate(b.column(b.num_columns - 1)):
                t = t.as_py()
                rows += [(i, n, *p) for n, p in enumerate(paragraphs_of(t))]
                held += len(t)
                if held >= GATHERED or len(rows) >= PIECES:
                    yield out(b, rows)
                    rows, held = [], 0
            yield out(b, rows)

    d = docs.select(*keys, text.alias("_text"))
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in d.schema.fields[:-1]), *(T.StructField(n, T.StringType() if t == pa.string() else T.IntegerType()) for n, t in tail)])
    return d.mapInArrow(run, schema)
