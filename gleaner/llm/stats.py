"""Statistics of whole texts, shared by the quality rules and the quality classifier.

Words are ``[^\\x20\\x09-\\x0D]+``: what bytes.split() gives for UTF-8.  A null
text has no words.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, only, strings

#: Words of a window that counts as repeated.
WINDOW = 8
_SYMBOLS = "#*$%&|<>"
_DROP = bytes(range(0x80, 0xC0))  # continuation bytes: what is left are code points
_SPACES = " \t\n\v\f\r"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Of the vectors below.
RATIOS = ["log_words", "word_len", "word_len_sd", "symbols", "dup_lines", "repeats", "upper", "punct", "digits", "distinct", "line_words", "compress", "entropy", "stop_len", "longest_run"]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in a window that occurs twice or more in the text."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    # names of the windows of 2, 4 and 8 words, exact by construction
    size, got = 1, a
    while size < window:
        pairs = got[: len(got) - size] * (int(got.max()) + 1) + got[size:]
        size *= 2
        uniq, got = np.unique(pairs, return_inverse=True)
        if len(uniq) == len(pairs):
            return 0
    twice = np.bincount(got)[got] > 1
    step = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(step, at, 1)
    np.add.at(step, at + window, -1)
    return int((np.cumsum(step[:n]) > 0).sum())


def counts(text: str) -> tuple[list[int], list[bytes], bytes]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; the words; the bytes."""
    data = text.encode()
    words = data.split()
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)], words, data


def ratios(text: str, c: list[int], words: list[bytes], data: bytes) -> list[float]:
    """RATIOS of a text; zeros for one without words."""
    n, chars, symbols, dups, repeats = c
    if not n:
        return [0.0] * len(RATIOS)
    sizes = np.fromiter(map(len, words), np.int64, n)
    points = chars / n
    upper = len(text) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")) - (len(text) - len(data))
    punct = len(data) - len(data.translate(None, b".,;:!?'\"()-_/\\[]{}=+~^@`"))
    digits = len(data) - len(data.translate(None, b"0123456789"))
    seen = Counter(words)
    share = np.fromiter(seen.values(), np.float64, len(seen)) / n
    n_lines = data.count(b"\n") + 1
    same = longest = 1
    if seen.most_common(1)[0][1] > 2:
        prev = None
        for w in words:
            same = same + 1 if w == prev else 1
            prev = w
            if same > longest:
                longest = same
    return [
        math.log1p(n),
        points,
        float(sizes.std()),
        math.log1p(100 * symbols / n),
        math.log1p(100 * dups / n_lines),
        math.log1p(100 * repeats / n),
        math.log1p(100 * max(upper, 0) / chars),
        math.log1p(100 * punct / chars),
        math.log1p(100 * digits / chars),
        len(seen) / n,
        math.log1p(n / n_lines),
        len(zlib.compress(data, 1)) / len(data),
        float(-(share * np.log(share)).sum()) / math.log(n + 1),
        float((sizes <= 3).sum()) / n,
        math.log(longest),
    ]


def text_statistics(docs: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """doc_id, the columns of `extra` (name -> type), COUNTS as longs, vec array<double> of RATIOS.

    One row for each row in; null texts are empty ones.
    """
    extra = extra or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 2 + len(extra)
        for b in batches:
            whole, vecs = [], []
            for t in strings(b.column(1)):
                c, words, data = counts(t)
                whole.append(c)
                vecs.append(ratios(t, c, words, data))
            whole = np.array(whole, np.int64).reshape(-1, len(COUNTS))
            flat = np.array(vecs, np.float64).reshape(-1)
            vec = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(RATIOS)), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), *[b.column(i) for i in range(2, k)], *[pa.array(np.ascontiguousarray(whole[:, i])) for i in range(len(COUNTS))], vec], ["doc_id", *extra, *COUNTS, "vec"])

    schema = ", ".join(["doc_id long", *[f"{c} {t}" for c, t in extra.items()], *[f"{c} long" for c in COUNTS], "vec array<double>"])
    return arrow_map(only(docs, doc_id="long", text="string", **extra), run, schema)
