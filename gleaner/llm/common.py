"""What the operators share: shared-folder stages, skew-safe joins, ranks.

Everything that must outlive a lost executor goes through :func:`stage`, a
Parquet table in the folder that ``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

#: Rows and bytes of one Arrow batch to Python: whole texts, so far fewer than Spark's default.
ARROW_ROWS, ARROW_BYTES = 1000, 32 << 20
#: Words: runs of bytes that are none of the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_own_root: list[str] = []
_made: list[tuple[SparkSession, str]] = []


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches, by settings of the session where it has none of its own, and make this package importable on executors."""
    for name, value in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(value))
    ship(spark)


def shared_root(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; only on one machine, our own where it names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="gleaner-"))
    return "file://" + _own_root[0]


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_root(spark)}/gleaner/{uuid.uuid4().hex}-{tag}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone; the folder is then the cluster's to clear
            return


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and it is computed once."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(_nullable(df.schema)).parquet(path)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def only(df: DataFrame, **types: str) -> DataFrame:
    """The columns an operator needs, cast; others (clashing names too) stay out of its way."""
    return df.select(*[df[c].cast(t).alias(c) for c, t in types.items()])


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, keeps: str = "") -> DataFrame:
    """mapInArrow; what workers have cached goes first, but for entries of the kind `keeps`.

    A worker serves one operator after another, and the caches of one would
    otherwise stay beside the data of the next.
    """
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keeps)
        yield from fn(batches)

    return df.mapInArrow(run, schema)


def forget(keeps: str = "") -> None:
    """Drop this worker's cached objects of other kinds, and give the memory back to the system."""
    cache = worker_cache()
    gone = [k for k in cache if k[0] != keeps]
    for k in gone:
        del cache[k]
    if gone:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def global_order(df: DataFrame, by: list[str], tag: str) -> tuple[DataFrame, str]:
    """df range-sorted by the columns `by` and staged, with columns _part and _at, and the name of the first.

    (_part, _at) rises with the order; _at is the place in the part.  Ranks need
    only the count of each part besides.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mid = F.monotonically_increasing_id()
    sorted_ = df.repartitionByRange(n, *[F.col(c) for c in by]).sortWithinPartitions(*by)
    marked = sorted_.withColumn("_id", mid).withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")
    return stage(marked, tag), "_part"


def worker_cache() -> dict:
    """A dictionary that outlives tasks of the Python worker; keys are tuples that begin with a kind (see forget)."""
    mod = sys.modules[__name__]
    if not hasattr(mod, "_cache"):
        mod._cache = {}
    return mod._cache


def strings(col: pa.Array) -> list[str]:
    """Nulls become empty texts."""
    return [x if x is not None else "" for x in col.to_pylist()]


def u64(a: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as the signed longs Spark has."""
    return pa.array(a.view(np.int64))


def sized_join(left: DataFrame, right: DataFrame, key: str | list[str], how: str = "left", limit: int = 10_000) -> DataFrame:
    """Join to a table with one row for each key: broadcast if it has at most limit rows.

    Beyond that it is shuffled; adaptive execution then splits the partition of
    a key that holds much of left, since right has one row for it.
    """
    return left.join(F.broadcast(right) if right.limit(limit + 1).count() <= limit else right, key, how)
