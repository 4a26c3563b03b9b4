"""Definition, outline and reference search over files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dredge.functions import symbols as S
from dredge.functions.text import language_of

DEF_COLUMNS = ["path", "name", "kind", "container", "line", "text"]


def _line(lines: list[str], n: int) -> str:
    return lines[n - 1].strip() if n <= len(lines) else ""


def definitions(files: DataFrame) -> DataFrame:
    """(path, name, kind, container, line, text) of all definitions; text is the trimmed source line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 4 + [pa.int32(), pa.string()]
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = S.extract(path, text)
                lines = text.split("\n") if found else []
                rows += [(path, d.name, d.kind, d.container, d.line, _line(lines, d.line)) for d in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], DEF_COLUMNS)

    source = files.where("text IS NOT NULL").where(language_of(F.col("path")) != "").select("path", "text")
    return source.mapInArrow(run, "path string, name string, kind string, container string, line int, text string")


def find_definitions(defs: DataFrame, name: str, nocase: bool = False) -> DataFrame:
    """Definitions of a name, in (path, line) order."""
    hit = F.lower("name") == name.lower() if nocase else F.col("name") == name
    return defs.where(hit).orderBy("path", "line", "name")


def outline(files: DataFrame, path: str) -> DataFrame:
    """All definitions in one file; raises if there is no such file."""
    one = files.where(F.col("path") == path)
    if one.isEmpty():
        raise FileNotFoundError(path)
    return definitions(one).orderBy("line", "name")


def find_references(files: DataFrame, name: str, nocase: bool = False) -> DataFrame:
    """(path, name, kind, line, text) of uses of a name; files without it are not scanned."""
    if not name:
        raise ValueError("a name is needed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = S.references(path, text, name)
                lines = text.split("\n") if found else []
                rows += [(path, name, kind, n, _line(lines, n)) for n, kind in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["path", "name", "kind", "line", "text"])

    source = files.where(F.col("text").contains(name)).select("path", "text")
    return source.mapInArrow(run, "path string, name string, kind string, line int, text string").orderBy("path", "line")


def as_text(rows: DataFrame) -> DataFrame:
    """``file:line: [kind Container.name] text`` for a text sink."""
    owner = F.when(F.col("container") != "", F.concat("container", F.lit("."))).otherwise("") if "container" in rows.columns else F.lit("")
    return rows.select(F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit(": ["), "kind", F.lit(" "), owner, "name", F.lit("] "), "text").alias("value"))
