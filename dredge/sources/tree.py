"""A file tree as a batch and a streaming data source.

``spark.read.format("filetree").option("path", root).load()`` lists regular files below a root (hidden
ones too, which Spark's own listing drops), depth first and sorted. Links are skipped unless ``follow``
is set; each real folder is then entered once. Listing is on the driver; files are read by the executors in
partitions of ``files_per_partition`` paths (not at all with ``contents`` false).

The stream (``changes`` true) gives, for every look, the files that are new or changed and those that went
away. A look's listing is a Parquet file in the folder ``listings`` (shared like the root; on the driver's
disk for a local master) and the offset is its number, so neither grows with the tree; contents are read by
the executors.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, size long, mtime_ns long, content binary"
CHANGES = "path string, size long, mtime_ns long, content binary, deleted boolean"


def walk(root: str, follow: bool = False, seen: frozenset[str] | None = None, base: str = "") -> Iterator[tuple[str, int, int]]:
    """(path relative to the root, size, mtime in ns) of regular files; unreadable folders are passed over."""
    real = os.path.realpath(root)
    seen = seen or frozenset()
    if real in seen:
        return
    seen = seen | {real}
    try:
        entries = sorted(os.scandir(root), key=lambda e: e.name)
    except OSError:
        return
    for e in entries:
        rel = f"{base}{e.name}"
        try:
            if e.is_symlink() and not follow:
                continue
            if e.is_dir():
                yield from walk(e.path, follow, seen, f"{rel}/")
            elif e.is_file():
                s = e.stat()
                yield rel, s.st_size, s.st_mtime_ns
        except OSError:
            continue


def read(root: str, rel: str) -> bytes | None:
    try:
        with open(os.path.join(root, rel), "rb") as f:
            return f.read()
    except OSError:
        return None


def contents(listing: DataFrame, root: str) -> DataFrame:
    """Rows (path, size, mtime_ns) below a root with their ``content``, read by the executors; null if unreadable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one file at a time in memory
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([read(root, one.column(0)[0].as_py())], pa.binary())], ["path", "size", "mtime_ns", "content"])

    return listing.select("path", "size", "mtime_ns").mapInArrow(run, SCHEMA)


class Paths(InputPartition):
    def __init__(self, files: list[tuple]):
        super().__init__(0)
        self.files = files


def _flag(options: dict, name: str, default: str = "false") -> bool:
    return str(options.get(name, default)).lower() == "true"


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.follow, self.contents = _flag(options, "follow"), _flag(options, "contents", "true")
        self.step = int(options.get("files_per_partition", "512"))

    def partitions(self):
        files = list(walk(self.root, self.follow))
        return [Paths(files[i : i + self.step]) for i in range(0, len(files), self.step)] or [Paths([])]

    def read(self, partition):
        for rel, size, mtime in partition.files:
            yield rel, size, mtime, read(self.root, rel) if self.contents else None


class TreeChanges(DataSourceStreamReader):
    """Each look lists the tree; a listing that differs from the last one becomes the next offset."""

    def __init__(self, options: dict):
        self.root, self.listings = options["path"], options["listings"]
        self.follow = _flag(options, "follow")
        self.step = int(options.get("files_per_partition", "512"))
        os.makedirs(self.listings, exist_ok=True)

    def _file(self, number: int) -> str:
        return os.path.join(self.listings, f"{number}.parquet")

    def _numbers(self) -> list[int]:
        return sorted(int(m[1]) for m in (re.fullmatch(r"(\d+)\.parquet", f) for f in os.listdir(self.listings)) if m)

    def _listing(self, number: int) -> dict[str, tuple[int, int]]:
        if not number:
            return {}
        t = pq.read_table(self._file(number))
        return {p: (s, m) for p, s, m in zip(*(t[c].to_pylist() for c in ("path", "size", "mtime_ns")), strict=True)}

    def initialOffset(self):
        return {"listing": 0}

    def latestOffset(self, *_):
        last = max(self._numbers(), default=0)
        now = {rel: (size, mtime) for rel, size, mtime in walk(self.root, self.follow)}
        if now != self._listing(last):
            last += 1
            table = pa.table({"path": pa.array(now, pa.string()), "size": pa.array([v[0] for v in now.values()], pa.int64()), "mtime_ns": pa.array([v[1] for v in now.values()], pa.int64())})
            pq.write_table(table, self._file(last) + ".new")
            os.replace(self._file(last) + ".new", self._file(last))
        return {"listing": last}

    def partitions(self, start, end):
        before, now = self._listing(start["listing"]), self._listing(end["listing"])
        rows = [(rel, *v, False) for rel, v in now.items() if before.get(rel) != v] + [(rel, None, None, True) for rel in before if rel not in now]
        return [Paths(rows[i : i + self.step]) for i in range(0, len(rows), self.step)] or [Paths([])]

    def read(self, partition):
        for rel, size, mtime, gone in partition.files:
            yield rel, size, mtime, None if gone else read(self.root, rel), gone

    def commit(self, end):
        for number in self._numbers():
            if number < end["listing"]:
                os.remove(self._file(number))


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return CHANGES if _flag(self.options, "changes") else SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return TreeReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return TreeChanges(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileTree)
