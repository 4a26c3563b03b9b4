"""Change streams: debouncing, the latest state of each path, and applying changes to a delta table."""

from __future__ import annotations

import threading
import uuid
from dataclasses import replace
from time import monotonic

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dredge.conf import EngineConf
from dredge.operators.delta import reconcile
from dredge.operators.index import Index
from dredge.operators.ranged import RANGE, carried, in_ranges, running
from dredge.schemas import DELTA
from dredge.sources.corpus import route
from dredge.sources.tree import contents


def numbered_bursts(changes: DataFrame, gap: str, time: str = "ts") -> DataFrame:
    """The changes with ``burst``: how many pauses of over ``gap`` lie before each. No task sees all changes."""
    ranged = in_ranges(changes, [time])
    before = carried(ranged, F.max(time), F.max("total"))
    lagged = F.lag(time).over(Window.partitionBy(RANGE).orderBy(time))
    paused = F.col(time) > F.coalesce(F.col("_lag"), F.col("before")) + F.expr(f"INTERVAL {gap}")
    marked = ranged.withColumn("_lag", lagged).join(before, RANGE).withColumn("_new", F.coalesce(paused, F.lit(False)).cast("int")).drop("before", "_lag")
    add = F.coalesce(F.col("before"), F.lit(0)) + F.col("inside")
    return running(marked, [time, F.desc("_new")], "burst", F.sum("_new"), F.sum("_new"), F.sum("total"), add).drop("_new", RANGE)


def debounced(changes: DataFrame, gap: str, key: str = "path", time: str = "ts") -> DataFrame:
    """(batch_start, batch_end, n, n_paths): bursts of changes with no pause of over ``gap``."""
    per = numbered_bursts(changes, gap, time).groupBy("burst").agg(F.min(time).alias("batch_start"), F.max(time).alias("batch_end"), F.count("*").alias("n"), F.count_distinct(key).alias("n_paths"))
    return per.drop("burst")


def burst_paths(changes: DataFrame, gap: str, key: str = "path", time: str = "ts") -> DataFrame:
    """(burst, key): the paths of each burst, once each, as rows."""
    return numbered_bursts(changes, gap, time).select("burst", key).distinct()


def bursts(changes: DataFrame, gap: str, by: str, time: str = "ts", watermark: str | None = None) -> DataFrame:
    """(by, batch_start, n) of bursts per key. Works on batches and, with a watermark, on streams."""
    source = changes.withWatermark(time, watermark) if watermark else changes
    w = source.groupBy(by, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return w.select(by, F.col("w.start").alias("batch_start"), "n")


def latest_state(changes: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The last values of each key in the given order."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v"))
    return last.select(key, *[F.col(f"v.{v}").alias(v) for v in values])


def as_delta(changes: DataFrame, seq: int, conf: EngineConf | None = None) -> DataFrame:
    """Rows of a file-tree change stream (path, size, mtime_ns, content, deleted) as delta rows.

    A file that does not belong into the index (too large, binary, unreadable) has no text there.
    """
    routed = route(changes, replace(conf or EngineConf(), max_index_mb=0))
    text = F.when(F.col("route") == "indexed", F.col("text"))
    return routed.select("path", "deleted", F.lit(seq).cast("long").alias("seq"), "size", "mtime_ns", text.alias("text"))


def rescan(indexed: DataFrame, listing: DataFrame, root: str, seq: int, conf: EngineConf | None = None) -> DataFrame:
    """Delta rows that bring an index (path, size, mtime_ns) up to a listing of the tree: after changes were missed."""
    found = reconcile(indexed, listing).where("change <> 'unchanged'")
    now = contents(listing.join(found.where("change <> 'deleted'").select("path"), "path", "left_semi"), root)
    gone = found.where("change = 'deleted'").select("path", F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("mtime_ns"), F.lit(None).cast("binary").alias("content"), F.lit(True).alias("deleted"))
    return as_delta(now.withColumn("deleted", F.lit(False)).unionByName(gone), seq, conf)


class DeltaWriter:
    """Applies a change stream to a delta table of Parquet files, a folder per micro-batch.

    A micro-batch every ``debounce_ms`` takes the changes since the last one together. A batch that runs again
    overwrites its own folder, so each is applied once. ``barrier`` returns when all changes that the source
    has listed are in the table, or after ``barrier_timeout_ms``. With an index, shards that have collected
    ``rebuild_threshold`` changes are written anew, every ``rebuild_interval_ms`` at most; the changes stay
    in the table, where they hide nothing newer.
    """

    def __init__(self, changes: DataFrame, folder: str, checkpoint: str, conf: EngineConf | None = None, index: Index | None = None):
        self.index, self.compacted = index, monotonic()
        self.spark, self.folder, self.conf = changes.sparkSession, folder.rstrip("/"), conf or EngineConf()
        writer = changes.writeStream.foreachBatch(self._apply).option("checkpointLocation", checkpoint).trigger(processingTime=f"{self.conf.debounce_ms} milliseconds")
        self.query = writer.queryName(f"delta-{uuid.uuid4().hex[:8]}").start()

    def _apply(self, batch: DataFrame, number: int) -> None:
        as_delta(batch, number, self.conf).write.mode("overwrite").parquet(f"{self.folder}/seq={number}-rows")
        if self.index is not None and monotonic() - self.compacted >= self.conf.rebuild_interval_ms / 1000:
            self.index.compact(self.delta(), self.conf.rebuild_threshold)
            self.compacted = monotonic()

    def barrier(self, timeout_ms: int | None = None) -> bool:
        """Whether the table has all changes; False if the time ran out (0: no limit), and reads may be stale."""
        limit = self.conf.barrier_timeout_ms if timeout_ms is None else timeout_ms
        waiting = threading.Thread(target=self.query.processAllAvailable, daemon=True)
        waiting.start()
        waiting.join(limit / 1000 if limit else None)
        return not waiting.is_alive()

    def progress(self) -> dict | None:
        """What the last micro-batch did, as Spark reports it."""
        return self.query.lastProgress

    def delta(self) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", "true").schema(DELTA).parquet(self.folder)

    def stop(self) -> None:
        self.query.stop()
