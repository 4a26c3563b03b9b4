"""Pending changes over an indexed corpus: overlay, deletion by prefix, reconciling, compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(delta: DataFrame) -> DataFrame:
    """The last change of each path (path, deleted, seq, size, text)."""
    rest = [c for c in delta.columns if c not in ("path", "seq")]
    last = delta.groupBy("path").agg(F.max_by(F.struct("seq", *rest), "seq").alias("v"))
    return last.select("path", *[F.col(f"v.{c}").alias(c) for c in ("deleted", "seq", *(r for r in rest if r != "deleted"))])


def with_mtime(files: DataFrame) -> DataFrame:
    """Rows with a column mtime_ns: as it is, or null if there is none."""
    return files if "mtime_ns" in files.columns else files.withColumn("mtime_ns", F.lit(None).cast("long"))


def overlay(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Files (path, size, mtime_ns, text) as of now: the base without any changed path, and the changed files that live."""
    now = latest(delta)
    live = with_mtime(now.where("NOT deleted"))
    columns = ["path", "size", "mtime_ns", "text"]
    return with_mtime(base.join(now.select("path"), "path", "left_anti")).select(columns).unionByName(live.select(columns))


def below(path: Column, folder: str) -> Column:
    return (path == folder) | path.startswith(f"{folder.rstrip('/')}/")


def delete_prefix(base: DataFrame, folder: str, seq: int) -> DataFrame:
    """Changes that delete a file or everything below a folder."""
    return base.where(below(F.col("path"), folder)).select(
        "path", F.lit(True).alias("deleted"), F.lit(seq).cast("long").alias("seq"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("string").alias("text")
    )


def reconcile(indexed: DataFrame, disk: DataFrame) -> DataFrame:
    """(path, change) of both listings (path, size, mtime_ns): new, deleted, changed or unchanged."""
    a = indexed.select("path", F.struct("size", "mtime_ns").alias("was"))
    b = disk.select("path", F.struct("size", "mtime_ns").alias("now"))
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("was").eqNullSafe(F.col("now")), "unchanged").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", change.alias("change"))


def dirty_shards(sharded: DataFrame, delta: DataFrame, threshold: int) -> DataFrame:
    """(shard, dirty) of shards to rewrite: those with ``threshold`` changes or more; all that have one if
    there are no more than ``threshold`` changes in all. New paths count for shard -1."""
    now = latest(delta).join(sharded.select("path", "shard"), "path", "left").select(F.coalesce("shard", F.lit(-1)).alias("shard"))
    per = now.groupBy("shard").agg(F.count("*").alias("dirty"))
    total = now.agg(F.count("*").alias("n"))
    return per.where((F.col("dirty") >= threshold) | (total.scalar() <= threshold))


def pending(delta: DataFrame, done: DataFrame) -> DataFrame:
    """Changes left after a compaction that saw ``done``: those of later sequence numbers."""
    seen = done.groupBy("path").agg(F.max("seq").alias("_seq"))
    return delta.join(seen, "path", "left").where(F.col("_seq").isNull() | (F.col("seq") > F.col("_seq"))).drop("_seq")


def containing_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, root): the longest root that is the path or a folder above it, or null; each path once.

    A path is joined by each of its own prefixes, so the join is on equal keys.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    at = paths.select("path", F.explode(above).alias("root")).join(roots.select("root").distinct().withColumn("found", F.lit(True)), "root", "left")
    return at.groupBy("path").agg(F.max_by(F.when(F.col("found"), F.col("root")), F.when(F.col("found"), F.length("root"))).alias("root"))
