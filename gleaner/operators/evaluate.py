"""recall@k of a set of cases, all of them in one job."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rank import blocks

#: Passages that one pass over the documents looks for.
MAX_PASSAGES = 20_000


def containing(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """doc, item_id of each passage (item_id, passage) that stands in a document (doc, text), by one automaton for all of them."""

    def of(known: dict[str, list[int]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            auto = ahocorasick.Automaton()
            for t, items in known.items():
                auto.add_word(t, items)
            auto.make_automaton()
            for b in batches:
                rows = [(i, item) for i, t in enumerate(b.column(1).to_pylist()) if known and t for item in sorted({x for _, items in auto.iter(t) for x in items})]
                at, items = list(zip(*rows, strict=True)) or ((), ())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(items, pa.int64())], ["doc", "item_id"])

        return run

    out = []
    for block in blocks(passages.filter("passage <> ''"), "item_id", MAX_PASSAGES):
        known = defaultdict(list)
        for r in block:
            known[r.passage].append(r.item_id)
        out.append(docs.select("doc", "text").mapInArrow(of(dict(known)), "doc string, item_id long"))
    return reduce(DataFrame.unionByName, out)


def recalled(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """Every case with recalled: some hit of its query (query_id) is in its doc, and at its para unless that is null."""
    c = cases.select("case_id", "query_id", "doc", "para")
    h = hits.select("query_id", F.col("doc").alias("_doc"), F.col("para").alias("_para"))
    on = (c["query_id"] == h["query_id"]) & (c["doc"] == h["_doc"]) & (c["para"].isNull() | (c["para"] == h["_para"]))
    found = c.join(h, on, "left_semi").select("case_id", F.lit(True).alias("recalled"))
    return c.join(found, "case_id", "left").withColumn("recalled", F.coalesce("recalled", F.lit(False)))


def recall(judged: DataFrame) -> DataFrame:
    """recall, hits, cases in one row."""
    return judged.agg(F.avg(F.col("recalled").cast("double")).alias("recall"), F.count_if("recalled").alias("hits"), F.count("*").alias("cases"))
