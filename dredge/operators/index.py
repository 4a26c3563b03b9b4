"""The trigram index: postings, shards, manifest, candidates, and searching through them."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dredge.operators.delta import dirty_shards, latest, overlay, with_mtime
from dredge.operators.ignores import TREE_FILE, load_rules
from dredge.operators.lines import Matcher
from dredge.operators.ranged import RANGE, in_ranges, running
from dredge.operators.symbols import DEF_COLUMNS, definitions, find_references
from dredge.plans.pattern import flags_free
from dredge.plans.search import scoped, search, united
from dredge.schemas import DEFS
from dredge.storage import deleted, file_system

SHARD_TARGET = 80 << 20
SHARD_MIN = 32 << 20


def trigram_keys(content: bytes) -> np.ndarray:
    """The distinct byte trigrams of a content with A to Z lowered, as sorted 24-bit keys."""
    b = np.frombuffer(content.lower(), np.uint8).astype(np.int32)
    return np.unique(b[:-2] << 16 | b[1:-1] << 8 | b[2:]) if len(b) >= 3 else np.zeros(0, np.int32)


def required_keys(m: Matcher) -> list[int]:
    """Trigrams that every file with a match holds.

    Without case, letters that fold to non-ASCII ones (k, s) and non-ASCII characters make no trigram,
    since the index folds only ASCII; a literal that folds only ASCII keeps them.
    """
    literal = m.literal if m.literal is not None else m.required
    if not literal:
        return []
    if m.folds_ascii or not m.nocase:
        safe = m.folds_ascii or flags_free(m.pattern, m.fixed)
        parts = [literal] if safe else _ascii_runs(literal)
    else:
        parts = _ascii_runs(literal)
    return sorted({int(k) for p in parts for k in trigram_keys(p.encode())})


def _ascii_runs(literal: str) -> list[str]:
    return "".join(c if c.isascii() and c not in "kKsS" else "\0" for c in literal).split("\0")


def postings(files: DataFrame, *carry: str) -> DataFrame:
    """(path, tri) of every distinct trigram of every file, with the carried columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            keys = [trigram_keys(t.as_buffer().to_pybytes()) if t.is_valid else np.zeros(0, np.int32) for t in texts]
            at = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]), pa.int64())
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int32)
            step = 1 << 18
            for i in range(0, max(1, len(flat)), step):
                yield pa.RecordBatch.from_arrays([*[c.take(at[i : i + step]) for c in batch.columns[:-1]], pa.array(flat[i : i + step], pa.int32())], [*batch.schema.names[:-1], "tri"])

    kinds = dict(files.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in ("path", *carry)] + ["tri int"])
    return files.select("path", *carry, "text").mapInArrow(run, schema)


def candidates(post: DataFrame, keys: list[int]) -> DataFrame:
    """Paths whose files hold all the trigrams: relational division of the postings."""
    if not keys:
        return post.select("path").distinct()
    hit = post.where(F.col("tri").isin(keys)).groupBy("path").agg(F.count_distinct("tri").alias("n"))
    return hit.where(F.col("n") == len(keys)).select("path")


#: Bytes of a range of paths, which one task packs, as a multiple of a shard's size.
RANGE_SHARDS = 1000
#: Files of a range at most: a task holds their sizes.
RANGE_FILES = 2_000_000
#: Shard numbers set aside for each range.
SHARDS_A_RANGE = 1_000_000


def crossings(sizes: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a range of files (sizes in path order) makes of the shard that is open before it, as arrays (upto, closed, filled).

    If that shard lacks ``upto`` bytes, or fewer but more than the entry before, ``closed`` shards are closed in the range
    and the one then open has ``filled`` bytes of it. If it lacks more than the last ``upto``, it gets the whole range and
    stays open. There are entries for the files of the first ``target`` bytes only.
    """
    upto = np.cumsum(sizes, dtype=np.int64)
    n, before = len(sizes), np.concatenate(([0], upto))
    at = np.arange(n + 1)
    end = np.searchsorted(upto, before + target) + 1  # the file after the one that fills a shard begun at a file
    onward, closed = np.where(end <= n, end, at), (end <= n).astype(np.int64)
    while (further := closed[onward]).any():  # twice as many shards at a time
        closed, onward = closed + further, onward[onward]
    first = 1 + np.arange(np.searchsorted(before[:-1], target))  # where the second shard may begin
    closed, filled = 1 + closed[first], before[n] - before[onward[first]]
    last = np.append((closed[1:] != closed[:-1]) | (filled[1:] != filled[:-1]), True)
    return upto[first - 1][last], closed[last], filled[last]


def packed(files: DataFrame, target: int = SHARD_TARGET, least: int = SHARD_MIN, apart: int = SHARDS_A_RANGE) -> DataFrame:
    """(path, size, shard): files in path order, a shard closed once it has ``target`` bytes; a last shard of under
    ``least`` bytes joins the one before. Equal paths go by size.

    The fold over all files is made of ranges of paths, one task each: every range tells what it makes of each shard that
    may be open before it (``crossings``), one task goes through these few numbers, and then each range is packed from the
    shard that is in fact open there. Numbers rise with the path; the first shard that a range closes is followed by one
    above range x ``apart``, so 0 numbers all shards 0, 1, 2 and so on.
    """

    def outlook(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1)[0].as_py()) for b in batches if b.num_rows]
        if parts:
            sizes = np.concatenate([p for p, _ in parts])
            upto, closed, filled = crossings(sizes, target)
            alike = [np.full(len(upto), v, np.int64) for v in (parts[0][1], sizes.sum())]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*alike, upto, closed, filled)], [RANGE, "total", "upto", "closed", "filled"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, at, lacks, filled, shard, earlier = [], -1, 0, 0, 0, 0
        for batch in batches:
            for part, total, upto, closed, left in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != at:
                    rows.append((part, filled, shard, earlier))
                    at, lacks, filled = part, target - filled, filled + total
                if lacks <= upto:
                    lacks, filled, before = math.inf, left, shard
                    shard = max(shard, part * apart) + closed
                    earlier = before if closed == 1 else shard - 1
        rows.append((-1, filled, shard, earlier))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [RANGE, "filled", "shard", "earlier"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, filled, shard = -1, 0, 0
        for batch in batches:
            shards = []
            for size, part in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if part != at:
                    at, (filled, shard, _) = part, begin[part]
                shards.append(min(shard, top))
                filled += size
                if filled >= target:
                    filled, shard = 0, max(shard, part * apart) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shards, pa.int32())], ["path", "size", "shard"])

    sizes = files.select("path", F.col("size").cast("long").alias("size"))
    total, count = sizes.agg(F.sum(F.least("size", F.lit(target))), F.count("*")).first()
    ranged = in_ranges(sizes, ["path"], max(1, -(-(total or 0) // (target * RANGE_SHARDS)), -(-count // RANGE_FILES))).sortWithinPartitions("path", "size")
    few = ranged.select("size", RANGE).mapInArrow(outlook, f"{RANGE} long, total long, upto long, closed long, filled long")
    found = few.repartition(1).sortWithinPartitions(RANGE, "upto").mapInArrow(walk, f"{RANGE} long, filled long, shard long, earlier long")
    begin = {part: state for part, *state in found.collect()}  # one for each range
    filled, last, earlier = begin.pop(-1, (0, 0, 0))
    top = earlier if filled < least else last
    return ranged.mapInArrow(run, "path string, size long, shard int")


def pack_shards(files: DataFrame, target: int = SHARD_TARGET, least: int = SHARD_MIN) -> DataFrame:
    """(path, shard) of ``packed``, with numbers set aside for each range."""
    return packed(files, target, least).select("path", "shard")


def manifest(sharded: DataFrame) -> DataFrame:
    """Per shard: path range, files, bytes."""
    return sharded.groupBy("shard").agg(F.min("path").alias("path_min"), F.max("path").alias("path_max"), F.count("*").alias("n_files"), F.sum("size").cast("long").alias("bytes"))


def shards_with(post: DataFrame, keys: list[int]) -> DataFrame:
    """Shards that hold all the trigrams somewhere: the others need not be read."""
    if not keys:
        return post.select("shard").distinct()
    hit = post.where(F.col("tri").isin(keys)).groupBy("shard").agg(F.count_distinct("tri").alias("n"))
    return hit.where(F.col("n") == len(keys)).select("shard")


def shard_of(paths: DataFrame, shards: DataFrame) -> DataFrame:
    """(path, shard): the shard whose path range holds each path, or -1. Ranges don't overlap.

    Paths and the ranges' starts are put in one order; the last start before a path tells its shard. No row
    meets another: a running maximum does it.
    """
    starts = shards.select(F.col("path_min").alias("path"), F.struct(F.col("path_min").alias("start"), F.col("path_max").alias("end"), "shard").alias("r"))
    none = F.lit(None).cast(dict(starts.dtypes)["r"])
    ranged = in_ranges(starts.withColumn("asked", F.lit(0)).unionByName(paths.select("path", none.alias("r"), F.lit(1).alias("asked"))), ["path"])
    at = running(ranged, ["path", "asked"], "at", F.max("r"), F.max("r"), F.max("total"), F.greatest("before", "inside")).where("asked = 1")
    return at.select("path", F.when(F.col("path") <= F.col("at.end"), F.col("at.shard")).otherwise(F.lit(-1)).alias("shard"))


def indexed_search(files: DataFrame, post: DataFrame, pattern: str, nocase: bool = False, fixed: bool = False, **filters) -> DataFrame:
    """As ``search`` for matches: candidates by trigram, then the exact test."""
    m = Matcher(pattern, fixed, nocase)
    keys = required_keys(m)
    subject = files.join(candidates(post, keys), "path", "left_semi") if keys else files
    return search(subject, pattern, nocase=nocase, fixed=fixed, **filters)


#: The most shards that a search names in its plan; beyond, they are a join.
NAMED_SHARDS = 10_000


class Index:
    """An index on disk: Parquet tables files, postings and defs, partitioned by generation and shard.

    A version is a Parquet table ``versions/<number>`` of (shard, gen), partitioned by gen: the generation that holds
    each shard.
    Building and compacting write a new generation and then the next version under another name, which a
    rename makes visible as a whole; the highest number is current. A reader keeps the version that it began
    with; generations and versions that are no longer current are deleted later, by ``clean``.
    """

    TABLES = {"files": "path string, size long, mtime_ns long, text string", "postings": "path string, tri int", "defs": DEFS}

    def __init__(self, spark: SparkSession, folder: str, progress: Callable[[str], None] | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.progress = progress or (lambda step: None)

    def _versions(self) -> list[int]:
        fs, path = file_system(self.spark, self.folder)
        base = path(f"{self.folder}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(base)] if fs.exists(base) else []
        return sorted(int(n) for n in names if re.fullmatch(r"\d+", n))

    def exists(self) -> bool:
        return bool(self._versions())

    def state(self) -> str:
        """The folder of the current version."""
        versions = self._versions()
        if not versions:
            raise FileNotFoundError(self.folder)
        return f"{self.folder}/versions/{versions[-1]}"

    def shards(self, state: str | None = None) -> DataFrame:
        """(shard, gen) of a version."""
        return self.spark.read.schema("shard int, gen string").parquet(state or self.state())

    def generations(self, state: str | None = None) -> list[str]:
        """The generations in use in a version: as many as compactions since the last full build, and one."""
        state = state or self.state()
        fs, path = file_system(self.spark, state)
        names = [s.getPath().getName() for s in fs.listStatus(path(state))]
        return sorted(n.removeprefix("gen=") for n in names if n.startswith("gen="))

    def _point(self, shards: DataFrame, after: int) -> str:
        """Make (shard, gen) the version after number ``after``; raises if another writer was faster."""
        fs, path = file_system(self.spark, self.folder)
        fresh, final = f"{self.folder}/versions/_{uuid.uuid4().hex}", f"{self.folder}/versions/{after + 1}"
        shards.select(F.col("shard").cast("int"), "gen").coalesce(1).write.partitionBy("gen").parquet(fresh)
        if fs.exists(path(final)) or not fs.rename(path(fresh), path(final)):
            raise RuntimeError("another writer has changed the index")
        return final

    def _write(self, sharded: DataFrame) -> tuple[str, DataFrame]:
        """A new generation of rows with a shard; its name and (shard, gen)."""
        gen = f"g{uuid.uuid4().hex}"
        out = {name: f"{self.folder}/{name}/gen={gen}" for name in self.TABLES}
        sharded.select("path", "size", "mtime_ns", "text", "shard").repartition("shard").sortWithinPartitions("shard", "path").write.partitionBy("shard").parquet(out["files"])
        self.progress("files")
        stored = self.spark.read.schema(f"{self.TABLES['files']}, shard int").parquet(out["files"])
        postings(stored, "shard").repartition("shard").sortWithinPartitions("shard", "tri", "path").write.partitionBy("shard").parquet(out["postings"])
        self.progress("postings")
        definitions(stored).join(stored.select("path", "shard"), "path").repartition("shard").write.partitionBy("shard").parquet(out["defs"])
        self.progress("defs")
        return gen, stored.select("shard", F.lit(gen).alias("gen")).distinct()

    def build(self, files: DataFrame, target: int = SHARD_TARGET, least: int = SHARD_MIN) -> str:
        """A full build of rows of path, size, mtime_ns, text; returns the version."""
        after = max(self._versions(), default=0)
        _, shards = self._write(with_mtime(files).join(pack_shards(files, target, least), "path"))
        return self._point(shards, after)

    def table(self, name: str, state: str | None = None) -> DataFrame:
        """A table of a version (the current one if none is pinned).

        The generations in use are as many as builds and compactions since the last full one; their folders
        are read as they are, and a join with the version's shards leaves out the shards that were replaced.
        """
        state = state or self.state()
        gens = self.generations(state)
        schema = f"{self.TABLES[name]}, gen string, shard int"
        if not gens:
            return self.spark.createDataFrame([], schema).drop("gen")
        rows = self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(*[f"{self.folder}/{name}/gen={g}" for g in gens])
        return rows.drop("gen") if len(gens) == 1 else rows.join(self.shards(state), ["shard", "gen"], "left_semi").drop("gen")

    def listing(self, folder: str = "", state: str | None = None) -> DataFrame:
        """(path, size, mtime_ns) of the indexed files below a folder, in path order."""
        files = self.table("files", state).select("path", "size", "mtime_ns")
        return (files.where(F.col("path").startswith(f"{folder.strip('/')}/")) if folder.strip("/") else files).orderBy("path")

    def file(self, path: str, state: str | None = None) -> DataFrame:
        """The one row of a file; raises if it is not indexed."""
        found = self.table("files", state).where(F.col("path") == path)
        if found.isEmpty():
            raise FileNotFoundError(path)
        return found

    def manifest(self, state: str | None = None) -> DataFrame:
        return manifest(self.table("files", state))

    def candidates(self, keys: list[int], state: str | None = None) -> DataFrame:
        """The files (with shard) that hold all the trigrams: shards without them are pruned as partitions, then files by posting."""
        files, post = self.table("files", state), self.table("postings", state)
        if not keys:
            return files
        hit = shards_with(post, keys)
        few = [r["shard"] for r in hit.limit(NAMED_SHARDS + 1).collect()]
        if len(few) <= NAMED_SHARDS:
            files, post = files.where(F.col("shard").isin(few)), post.where(F.col("shard").isin(few))
        else:
            files, post = files.join(hit, "shard", "left_semi"), post.join(hit, "shard", "left_semi")
        return files.join(candidates(post, keys), "path", "left_semi")

    def _subject(self, keys: list[int], delta: DataFrame | None, filters: dict) -> tuple[DataFrame, dict]:
        """The files to read as of now, and the filters with the rules of all ignore files."""
        state = self.state()
        if filters.get("gitignore") is True:
            listed = self.table("files", state).where(F.col("path").endswith(TREE_FILE))
            filters = filters | {"gitignore": load_rules(listed if delta is None else overlay(listed, delta))}
        files = self.candidates(keys, state)
        return files if delta is None else overlay(files, delta), filters

    def search(self, pattern: str, nocase: bool = False, fixed: bool = False, delta: DataFrame | None = None, rest: DataFrame | None = None, limit: int = 0, **filters) -> DataFrame:
        """Search results as of ``plans.search``, read through the index.

        Files with a change in ``delta`` are searched as they are now, without the index. ``rest`` are files
        that are not indexed (too large, or beyond the budget); their results come after the others.
        """
        files, filters = self._subject(required_keys(Matcher(pattern, fixed, nocase)), delta, filters)
        if rest is not None and delta is not None:
            rest = rest.join(latest(delta).select("path"), "path", "left_anti")
        options = dict(nocase=nocase, fixed=fixed, **filters)
        if rest is None:
            return search(files, pattern, limit=limit, **options)
        return united(search(files, pattern, **options), search(rest, pattern, **options), limit)

    def definitions(self, delta: DataFrame | None = None) -> DataFrame:
        """All definitions; those of changed files are read from the changes."""
        stored = self.table("defs").drop("shard")
        if delta is None:
            return stored
        now = latest(delta)
        return stored.join(now.select("path"), "path", "left_anti").select(*DEF_COLUMNS).unionByName(definitions(now.where("NOT deleted")))

    def references(self, name: str, delta: DataFrame | None = None, limit: int = 0, **filters) -> DataFrame:
        """Uses of a name in (path, line) order, the first ``limit`` of them: only files with its trigrams are read."""
        if not name:
            raise ValueError("a name is needed")
        files, filters = self._subject([int(k) for k in trigram_keys(name.encode())], delta, filters)
        found = find_references(scoped(files, **filters), name)
        return found.limit(limit) if limit else found

    def compact(self, delta: DataFrame, threshold: int = 20) -> list[int]:
        """Write shards with enough changes anew; new files become a shard of their own. Returns the shards.

        Changes of those shards are then in the index; applying them once more does no harm, so they may
        be dropped from the delta at any later time (``delta.pending``).
        """
        after = max(self._versions(), default=0)
        state = self.state()
        files = self.table("files", state)
        hit = sorted(r["shard"] for r in dirty_shards(files, delta, threshold).collect())  # as many as changes / threshold at most
        if not hit:
            return []
        shards = self.shards(state)
        fresh = (shards.agg(F.max("shard")).first()[0] or 0) + 1
        own = files.select("path", F.col("shard").alias("_own"))
        live = with_mtime(latest(delta)).where("NOT deleted").join(own, "path", "left").withColumn("_own", F.coalesce("_own", F.lit(-1))).where(F.col("_own").isin(hit))
        live = live.select("path", "size", "mtime_ns", "text", F.when(F.col("_own") < 0, F.lit(fresh)).otherwise(F.col("_own")).cast("int").alias("shard"))
        kept = files.where(F.col("shard").isin(hit)).join(latest(delta).select("path"), "path", "left_anti").select("path", "size", "mtime_ns", "text", "shard")
        _, written = self._write(kept.unionByName(live))
        self._point(shards.where(~F.col("shard").isin(hit)).unionByName(written), after)
        return hit

    def clean(self) -> list[str]:
        """Delete generations that no shard of the current version is in, and older versions; the generations' names."""
        fs, path = file_system(self.spark, self.folder)
        used, gone = {f"gen={g}" for g in self.generations()}, set()
        for name in self.TABLES:
            base = path(f"{self.folder}/{name}")
            for s in fs.listStatus(base) if fs.exists(base) else []:
                if s.getPath().getName() not in used:
                    gone.add(s.getPath().getName().removeprefix("gen="))
                    fs.delete(s.getPath(), True)
        for number in self._versions()[:-1]:
            fs.delete(path(f"{self.folder}/versions/{number}"), True)
        return sorted(gone)

    def size(self) -> int:
        """Bytes on disk."""
        fs, path = file_system(self.spark, self.folder)
        return fs.getContentSummary(path(self.folder)).getLength()

    def forget(self) -> bool:
        """Delete the index; whether there was one."""
        return deleted(self.spark, self.folder)
