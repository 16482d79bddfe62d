"""Embedders are functions from a list of texts to a matrix; this wraps them for columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import EMBED_DIM
from .text import let

#: Tokens of a text that are embedded: what a model of 1024 has room for beside its two marks.
BUDGET = 1022
_TOKEN = re.compile(r"\w+|[^\w\s]")
Embedder = Callable[[list[str]], np.ndarray]


def hash_embedder(texts: list[str], dim: int = EMBED_DIM) -> np.ndarray:
    """Deterministic stand-in for a model: each character adds its code mod 13 at its UTF-8 offset mod dim."""
    out = np.zeros((len(texts), dim), np.float32)
    for row, t in enumerate(texts):
        codes = np.array([ord(c) for c in t], np.int64)
        if len(codes):
            size = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
            np.add.at(out[row], (np.cumsum(size) - size) % dim, (codes % 13).astype(np.float32))
    return out


def truncated(text: str, budget: int = BUDGET) -> str:
    """The text up to the end of its token number `budget`; tokens are runs of letters and digits, and other characters one by one."""
    if len(text) <= budget:
        return text
    for n, m in enumerate(_TOKEN.finditer(text), 1):
        if n == budget:
            return text[: m.end()]
    return text


def prepared(embedder: Embedder, budget: int = BUDGET) -> Embedder:
    """The embedder with texts held to a budget of tokens and vectors of length one (a zero vector stays zero)."""

    def run(texts: list[str]) -> np.ndarray:
        v = np.asarray(embedder([truncated(t, budget) for t in texts]), np.float64)
        norm = np.sqrt((v * v).sum(1, keepdims=True)) if len(v) else v
        return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0).astype(np.float32)

    return run


def embed(text: Column, embedder: Embedder = hash_embedder) -> Column:
    """Arrow batches to the embedder, which a worker can build once and keep."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(np.asarray(embedder(s.fillna("").tolist()), np.float32)))

    return run(text)


def l2_normalize(v: Column) -> Column:
    """Unit length, summed in double; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return let(norm, lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: (x.cast("double") / n).cast("float"))))
