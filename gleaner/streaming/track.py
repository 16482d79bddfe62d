"""Listings as a stream: which files are new, changed, touched, unchanged or absent, whatever order their rows come in.

Each row says that a path was seen at a time, with an mtime and a hash.  Two
aggregations keep the state.  The first makes one sighting of the rows of a path
and a time, and passes it on once the watermark is past it, so rows that come
late, but within the watermark's delay, change nothing.  The second gathers the
sightings of a path in windows of a period and a step, a step apart: when a window
is over, the statuses of its last step follow from its sightings, since what
matters to a sighting lies within a period before it.  So a status comes out at
most a step after the watermark has passed its time, and no sighting is kept
longer than a period and a step.  A path that is not seen again within the period of the listings
is absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.catalog import Catalog

LISTING = "path string, mtime long, hash string, seen timestamp"
STATUS = "path string, seen timestamp, status string"
#: The state lies in this store, outside the JVM's heap.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _statuses(sightings: Column, period_ms: int) -> Column:
    """Array of (at, status) of sightings (at, mtime, hash) in order of time: what each is, and that the path is absent where none follows within the period."""

    def of(x: Column, i: Column) -> Column:
        before, after = F.get(sightings, i - 1), F.get(sightings, i + 1)
        known = F.coalesce(before["at"] + period_ms >= x["at"], F.lit(False))
        status = F.when(~known, "new").when(~x["hash"].eqNullSafe(before["hash"]), "changed").when(~x["mtime"].eqNullSafe(before["mtime"]), "touched").otherwise("unchanged")
        gone = F.when(F.coalesce(x["at"] + period_ms < after["at"], F.lit(True)), "absent")
        return F.array(F.struct(x["at"].alias("at"), status.alias("status")), F.struct((x["at"] + period_ms).alias("at"), gone.alias("status")))

    return F.flatten(F.transform(sightings, of))


def track(listings: DataFrame, period_ms: int, delay: str = "1 hour", step_ms: int | None = None) -> DataFrame:
    """path, seen, status of a stream of LISTING; rows that come more than `delay` after the newest are dropped.

    period_ms: the time between listings, after which a path that isn't seen again is absent.
    Of several sightings at one time the greatest counts.  step_ms: see above, half the period if not given; a
    sighting is kept in so many windows as steps go into a period, and one more.
    """
    step = step_ms or max(1, period_ms // 2)
    rows = listings.filter("path IS NOT NULL AND seen IS NOT NULL").withColumn("seen", F.date_trunc("millisecond", "seen")).withWatermark("seen", delay)
    once = rows.groupBy("path", "seen").agg(F.max(F.struct("mtime", "hash")).alias("x"))
    seen = F.struct(F.unix_millis("seen").alias("at"), "x.mtime", "x.hash")
    windows = once.groupBy("path", F.window("seen", f"{period_ms + step} milliseconds", f"{step} milliseconds").alias("w")).agg(F.sort_array(F.collect_list(seen)).alias("s"))
    told = windows.select("path", F.unix_millis("w.end").alias("end"), F.explode(_statuses(F.col("s"), period_ms)).alias("x"))
    return told.filter("x.status IS NOT NULL AND x.at < end").filter(F.col("x.at") >= F.col("end") - step).select("path", F.timestamp_millis("x.at").alias("seen"), "x.status")


def follow(statuses: DataFrame, catalog: Catalog, checkpoint: str) -> StreamingQuery:
    """Delete what becomes absent from an index; a batch that runs again deletes nothing more.

    A path that came back in the same batch stays.
    """

    def put(batch: DataFrame, _: int) -> None:
        last = batch.groupBy("path").agg(F.max_by("status", "seen").alias("status"))
        catalog.delete(last.filter("status = 'absent'").select("path"))

    return statuses.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
