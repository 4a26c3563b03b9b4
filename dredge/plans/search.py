"""The planner: one search request becomes one DataFrame plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dredge.conf import parse_size
from dredge.functions import paths
from dredge.functions.text import window
from dredge.operators.ignores import load_rules, without_ignored
from dredge.operators.lines import Matcher, lines, matching_lines, matching_spans, split_lines
from dredge.plans.pattern import BadPattern
from dredge.sources.corpus import searchable

MODES = ("matches", "files", "count", "occurrences")
MAX_PATTERN = 10_000


def scoped(
    files: DataFrame,
    subtree: str = "",
    globs: Sequence[str] = (),
    exclude: Sequence[str] = (),
    include: Sequence[str] = (),
    gitignore: Sequence | DataFrame | bool = (),
    hidden: bool = False,
    max_filesize: int | str | None = None,
    text: bool = False,
) -> DataFrame:
    """The files that a request looks at, with ``path`` relative to the subtree and ``_root_path`` as it was.

    Hidden, glob and exclude/include tests see the relative path, ignore rules the whole one. A file that
    ``include`` names is kept though it is excluded or ignored. gitignore: rules as lines, as a table of
    ``operators.ignores``, or True for those of the ignore files among ``files``.
    """
    out = searchable(files, text)
    whole = F.col("path")
    folder = subtree.strip("/")
    if folder:
        out = out.where(whole.startswith(f"{folder}/"))
    if max_filesize is not None:
        out = out.where(F.col("size") <= (parse_size(max_filesize) if isinstance(max_filesize, str) else max_filesize))
    out = out.withColumn("_root_path", whole)
    if folder:
        out = out.withColumn("path", F.substring("path", len(folder) + 2, 1 << 30))
    path = F.col("path")
    if not hidden:
        out = out.where(~paths.hidden(path))
    kept = paths.exclude_include(path, exclude, include)
    if kept is not None:
        out = out.where(kept)
    if globs:
        out = out.where(paths.glob_match(path, globs))
    if gitignore is True:
        gitignore = load_rules(files.select("path", "text"))
    if isinstance(gitignore, DataFrame):
        git = paths.ignored(F.col("_root_path"), [])
        out = out.where(~git | paths.any_glob(path, include) if include else ~git)
        out = without_ignored(out, gitignore, include, "_root_path")
    elif gitignore:
        drop = paths.ignored(F.col("_root_path"), gitignore)
        out = out.where(~drop | paths.any_glob(path, include) if include else ~drop)
    return out


def checked(pattern: str, fixed: bool, nocase: bool) -> Matcher:
    """The matcher of a pattern."""
    if len(pattern) > MAX_PATTERN:
        raise BadPattern("the pattern is too long")
    return Matcher(pattern, fixed, nocase)


def search(
    files: DataFrame,
    pattern: str,
    nocase: bool = False,
    fixed: bool = False,
    mode: str = "matches",
    scope: str = "line",
    limit: int = 0,
    max_columns: int = 0,
    location_only: bool = False,
    **filters,
) -> DataFrame:
    """Search results by mode.

    matches: path, line, text, col, line_len in (path, line) order, the first ``limit`` of them (0: all).
    files: path of each file with a match. count: matching lines per file. occurrences: matches per file.
    A line longer than ``max_columns`` bytes (if over 0) is shown as a window around its first match, or
    as an empty text with ``location_only``. ``limit`` holds only for matches.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    m = checked(pattern, fixed, nocase)
    subject = scoped(files, **filters)
    text = F.col("text")
    if mode == "files" and scope == "file":
        return subject.where(m.hits(text)).select("path").distinct().orderBy("path")
    if mode == "files":
        # decided within the row: no line is exploded, the first hit ends it
        need = m.prefilter(text)
        subject = subject if need is None else subject.where(need)
        if m.linear:
            subject = lines(subject).where(m.hits(text))
        elif m.literal is None:
            subject = subject.where(F.exists(split_lines(text), m.hits))
        elif need is None:
            subject = subject.where(m.hits(text))
        return subject.select("path").distinct().orderBy("path")
    if mode == "occurrences":
        if scope == "file":
            per = subject.select("path", m.count(text).alias("count"))
        else:
            per = lines(subject if m.prefilter(text) is None else subject.where(m.prefilter(text))).where(m.hits(text)).select("path", m.count(text).alias("count"))
        return per.groupBy("path").agg(F.sum("count").alias("count")).where("count > 0").orderBy("path")
    rows = matching_spans(subject, m) if scope == "file" else matching_lines(subject, m)
    if mode == "count":
        return rows.groupBy("path").agg(F.count("*").alias("count")).orderBy("path")
    if max_columns > 0:
        long = F.col("line_len") > max_columns
        rows = rows.withColumn("text", F.when(long, F.lit("") if location_only else window(F.col("text"), F.col("col"), max_columns)).otherwise(F.col("text")))
    rows = rows.orderBy("path", "line")
    return rows.limit(limit) if limit else rows


def done(matches: DataFrame, limit: int = 0) -> DataFrame:
    """One row: matches shown, files with a match shown, and whether the limit left some out."""
    n = F.count("*")
    if not limit:
        return matches.agg(n.alias("matches"), F.count_distinct("path").alias("file_hits"), F.lit(False).alias("truncated"))
    more = matches.orderBy("path", "line").limit(limit + 1)
    total = more.agg(F.count("*").alias("n"))
    shown = more.orderBy("path", "line").limit(limit).agg(n.alias("matches"), F.count_distinct("path").alias("file_hits"))
    return shown.withColumn("truncated", total.scalar() > limit)


def united(indexed: DataFrame, rest: DataFrame, limit: int = 0) -> DataFrame:
    """Results of one search over indexed files, then those over files that are not, each in its order.

    A path that has results in both (a file that has just moved between the sets) keeps the first. The limit
    holds for matches, over both.
    """
    order = [c for c in ("path", "line") if c in indexed.columns]
    rest = rest.join(indexed.select("path").distinct(), "path", "left_anti").select(indexed.columns)
    both = indexed.withColumn("_set", F.lit(0)).unionByName(rest.withColumn("_set", F.lit(1))).orderBy("_set", *order)
    return (both.limit(limit) if limit and "line" in order else both).drop("_set")


def as_text(matches: DataFrame, prefix: str = "") -> DataFrame:
    """Lines ``file:line:text`` for a text sink."""
    return matches.select(F.concat(F.lit(prefix), "path", F.lit(":"), F.col("line").cast("string"), F.lit(":"), "text").alias("value"))


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON object per row for a text sink."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def as_events(matches: DataFrame, limit: int = 0) -> DataFrame:
    """JSON objects for a text sink: one per match shown, then the one that ends the search, ``done``."""
    shown = matches.orderBy("path", "line")
    shown = shown.limit(limit) if limit else shown
    rows = shown.select(F.lit(0).alias("_end"), "path", "line", F.to_json(F.struct(F.lit("match").alias("type"), *matches.columns)).alias("value"))
    last = done(matches, limit)
    end = last.select(F.lit(1).alias("_end"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line"), F.to_json(F.struct(F.lit("done").alias("type"), *last.columns)).alias("value"))
    return rows.unionByName(end).orderBy("_end", "path", "line").select("value")
