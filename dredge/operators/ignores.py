"""Ignore files: rules read from the files of a corpus, each holding below the folder that its file is in."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dredge.functions.paths import any_glob, rule_pattern
from dredge.functions.text import basename

#: The ignore file of version control, in any folder, for searches that ask for it.
TREE_FILE = ".gitignore"
#: The ignore file of an index, in the root only: what it names is not indexed.
ROOT_FILE = ".dredgeignore"


def _patterns():
    @F.arrow_udf("string")
    def pattern(rules: pa.Array) -> pa.Array:
        return pa.array([None if r is None else rule_pattern(r) for r in rules.to_pylist()], pa.string())

    return pattern


def load_rules(files: DataFrame, name: str = TREE_FILE, root_only: bool = False) -> DataFrame:
    """(folder, pattern) of all rules in the ignore files among rows of path, text. The folder of the root is empty.

    They are read with every request, so an edited ignore file holds at once.
    """
    here = files.where(F.col("path") == name if root_only else basename(F.col("path")) == name)
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    lines = here.where("text IS NOT NULL").select(folder.alias("folder"), F.explode(F.split("text", "\n")).alias("rule"))
    return lines.select("folder", _patterns()("rule").alias("pattern")).where("pattern IS NOT NULL")


def ignored_paths(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """The paths that a rule of a folder above matches; a path meets the rules of its own folders only."""
    parts = F.split("path", "/")
    levels = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("folder"), F.array_join(F.slice(parts, n + 1, F.size(parts)), "/").alias("below")),
    )
    at = paths.select("path", F.inline(levels))
    return at.join(rules, "folder").where(F.rlike("below", F.col("pattern"))).select("path").distinct()


def without_ignored(files: DataFrame, rules: DataFrame, include: list[str] | tuple[str, ...] = (), column: str = "path") -> DataFrame:
    """The files that no rule matches, and those that ``include`` names. ``column`` has the path below the root."""
    hit = ignored_paths(files.select(F.col(column).alias("path")), rules).withColumnRenamed("path", column)
    if not include:
        return files.join(hit, column, "left_anti").select(files.columns)
    named = any_glob(F.col("path"), include)
    return files.where(named).unionByName(files.where(~named).join(hit, column, "left_anti").select(files.columns))
