"""Ingestion as a stream: new files of (path, content, mtime) become upserts of an index.

A batch is merged by content hash, so a batch that is run again after a failure
changes nothing more: the sink is idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.catalog import Catalog

SCHEMA = "path string, content string, mtime long"


def latest(batch: DataFrame) -> DataFrame:
    """One row a path, the one with the greatest mtime (then content)."""
    w = W.partitionBy("path").orderBy(F.desc("mtime"), F.desc("content"))
    return batch.filter("path IS NOT NULL AND content IS NOT NULL").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def stream_documents(spark: SparkSession, source: str, per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(source)


def ingest(docs: DataFrame, catalog: Catalog, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Upsert every micro-batch of a streaming DataFrame into the catalog."""

    def put(batch: DataFrame, _: int) -> None:
        catalog.upsert(latest(batch))

    writer = docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
