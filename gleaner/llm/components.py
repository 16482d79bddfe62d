"""Connected components of links between longs, on the executors alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, drop_path, new_path, stage

#: So many links at most are followed to their ends by one task.
FEW = 10_000


class Forest:
    """Union-find over the nodes that one partition links."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while x != r:
            up[x], x = r, up.get(x, x)
        return r

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.root(x), self.root(y)
            if x != y:
                x, y = min(x, y), max(x, y)
                self.up[y] = x
                self.up.setdefault(x, x)

    def links(self) -> pa.RecordBatch:
        """Each node but the roots with its root."""
        a = [x for x in self.up if self.root(x) != x]
        return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array([self.root(x) for x in a], pa.int64())})

    def nodes(self) -> pa.RecordBatch:
        """Each node with its root."""
        return pa.RecordBatch.from_pydict({"node": pa.array(list(self.up), pa.int64()), "to": pa.array([self.root(x) for x in list(self.up)], pa.int64())})


def local_forest(links: DataFrame) -> DataFrame:
    """Links a, b with the same components, fewer than the nodes in each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Forest()
        for b in batches:
            f.link(b.column(0).to_numpy(), b.column(1).to_numpy())
        yield f.links()

    return arrow_map(links.select("a", "b"), run, "a long, b long")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    f = Forest()
    for b in batches:
        f.link(b.column(0).to_numpy(), b.column(1).to_numpy())
    yield f.nodes()


def connected_components(links: DataFrame) -> DataFrame:
    """node, root for every node in links (a, b longs, not null): the smallest node that can be reached.

    Each round draws an order of the nodes, and every node moves to the first
    among itself and its neighbours.  Links move with their ends, and those whose
    ends meet or that have become equal go, so that a round joins a part of
    what the one before it did: all rounds together join some multiple of the links,
    whatever the size of a component.  Once FEW links or fewer are left, one task moves
    every node to its end, as a round would write several small tables for next to nothing.
    The moves are then followed backwards, from the
    smallest table on.  Each round is written to the shared folder; the joins are
    to tables with one row for each node, so a hub is split by adaptive
    execution.  No links: no rows.
    """
    spark = links.sparkSession
    base = new_path(spark, "components")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    def plain(df: DataFrame, x: str, y: str) -> DataFrame:
        return df.filter(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()

    edges, moves = kept(plain(links, "a", "b"), "links-0"), []
    while left := edges.count():
        step = len(moves)
        if left <= FEW:
            move = arrow_map(edges.coalesce(1), _ends, "node long, to long")
        else:
            drawn = lambda c: F.xxhash64(F.lit(step), c)  # noqa: B023, E731
            both = edges.union(edges.select("b", "a"))
            near = both.groupBy(F.col("a").alias("node")).agg(F.min_by("b", drawn("b")).alias("to"))
            move = near.select("node", F.when(drawn("node") < drawn("to"), F.col("node")).otherwise(F.col("to")).alias("to"))
        moves.append(kept(move, f"moves-{step}"))
        x, y = moves[-1].toDF("a", "x"), moves[-1].toDF("b", "y")
        edges = kept(plain(edges.join(x, "a").join(y, "b"), "x", "y"), f"links-{step + 1}")
        drop_path(spark, f"{base}/links-{step}")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    ends = moves.pop()
    while moves:
        move = moves.pop()
        ends = kept(move.join(ends.toDF("to", "end"), "to", "left").select("node", F.coalesce("end", "to").alias("to")), f"ends-{len(moves)}")
    least = ends.groupBy("to").agg(F.min("node").alias("root"))
    return kept(ends.join(least, "to").select("node", "root"), "roots")


def name_components(nodes: DataFrame, links: DataFrame, node: str) -> DataFrame:
    """nodes (a row for each: the column `node`, and least) with root and component_id: the least `least` of the component.

    Nodes without links are components of their own and take no part in the
    exchanges by root; one root may have most of the others, so its table is
    written first and the join, to one row a root, is split where it is skewed.
    """
    both = stage(nodes.select(node, "least").join(connected_components(links).withColumnRenamed("node", node), node, "left"), "component-nodes")
    ids = stage(both.filter("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    linked = both.filter("root IS NOT NULL").join(ids, "root").select(node, "root", "component_id")
    return linked.unionByName(both.filter("root IS NULL").select(node, F.col(node).alias("root"), F.col("least").alias("component_id")))
