"""A command line over a folder: python -m dredge.cli [search|def|refs|symbols|status|forget] ... ROOT.

With ``--index FOLDER`` a root gets an index there (a subfolder named by its hash), and requests read it: each
request first lists the tree and brings the index up to date with what has changed, unless ``--no-sync``. A
root inside an indexed one is searched as a part of that, unless ``--allow-nested``. Files that are not
indexed (too large, beyond the byte budget) are read with every request. Without an index folder, or for
a corpus too small for one, every request reads the tree.

Exit codes: 0 with a result, 1 without, 2 on an error.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dredge.conf import EngineConf
from dredge.functions.paths import GIT
from dredge.functions.text import root_hash
from dredge.operators import symbols as Y
from dredge.operators.delta import overlay
from dredge.operators.ignores import ROOT_FILE, load_rules, without_ignored
from dredge.operators.index import Index
from dredge.plans import search as S
from dredge.sources import corpus as C
from dredge.sources import tree
from dredge.storage import checkpointed
from dredge.streaming.changes import rescan


def arguments(argv: list[str]) -> argparse.Namespace:
    conf = EngineConf.load()
    p = argparse.ArgumentParser(prog="dredge", exit_on_error=False)
    p.add_argument("op", choices=("search", "def", "refs", "symbols", "status", "forget"))
    p.add_argument("what", nargs="?", default="", help="pattern, name or file")
    p.add_argument("root", nargs="?", default=".")
    p.add_argument("-i", dest="nocase", action="store_true")
    p.add_argument("-F", dest="fixed", action="store_true")
    p.add_argument("-l", dest="mode", action="store_const", const="files", default="matches")
    p.add_argument("-c", dest="mode", action="store_const", const="count")
    p.add_argument("-g", dest="globs", action="append", default=[])
    p.add_argument("--exclude", action="append", default=list(conf.exclude))
    p.add_argument("--include", action="append", default=[])
    p.add_argument("--gitignore", action="store_true", default=conf.gitignore)
    p.add_argument("--hidden", action="store_true")
    p.add_argument("-a", "--text", action="store_true")
    p.add_argument("-L", "--follow", action="store_true")
    p.add_argument("--max-filesize")
    p.add_argument("--limit", type=int, default=conf.limit)
    p.add_argument("--max-columns", type=int, default=conf.max_columns)
    p.add_argument("--json", action="store_true")
    p.add_argument("--index", metavar="FOLDER")
    p.add_argument("--no-sync", dest="sync", action="store_false")
    p.add_argument("--allow-nested", action="store_true")
    return p.parse_intermixed_args(argv)


class Root:
    """A folder to search: its files as they are, or an index of them."""

    def __init__(self, spark: SparkSession, a: argparse.Namespace, conf: EngineConf):
        self.spark, self.follow, self.conf = spark, a.follow, conf
        self.root, self.subtree, self.base = os.path.abspath(a.root), "", a.index and a.index.rstrip("/")
        if self.base and not a.allow_nested:
            above = self.root
            while not self._index(above).exists() and os.path.dirname(above) != above:
                above = os.path.dirname(above)
            if self._index(above).exists():
                self.root, self.subtree = above, os.path.relpath(self.root, above).replace(os.sep, "/").removeprefix(".")
        self.index = self._index(self.root) if self.base else None

    def _index(self, root: str) -> Index:
        name = self.spark.range(1).select(root_hash(F.lit(root), F.lit(self.follow))).first()[0]
        return Index(self.spark, f"{self.base}/{name}", lambda step: print(f"dredge: {step} written", file=sys.stderr))

    def _tree(self, contents: bool = True) -> DataFrame:
        return self.spark.read.format("filetree").option("path", self.root).option("follow", str(self.follow)).option("contents", str(contents)).load()

    def files(self) -> DataFrame:
        """All files, routed; what the root's own ignore file names is left out, and version control's folder."""
        routed = C.route(self._tree().where(~F.col("path").rlike(GIT)), self.conf)
        return without_ignored(routed, load_rules(routed, ROOT_FILE, root_only=True))

    def indexed(self) -> bool:
        """Whether there is an index, made now if the corpus is worth one."""
        if self.index is None or self.index.exists():
            return self.index is not None
        if not self.conf.uses_index(self._tree(contents=False).agg(F.sum("size")).first()[0] or 0):
            return False
        self.build()
        return True

    def build(self) -> None:
        """Files without a place in the index (binary, unreadable) are in it without text, so they count as known."""
        files = self.files().where("route IN ('indexed', 'binary', 'error')").withColumn("text", F.expr("CASE WHEN route = 'indexed' THEN text END"))
        self.index.build(files, self.conf.shard_target_mb << 20, self.conf.shard_min_mb << 20)

    def _listing(self) -> tuple[DataFrame, DataFrame]:
        """What the index should hold, and what it should not: files too large or beyond the byte budget."""
        listing = self._tree(contents=False).drop("content").where(~F.col("path").rlike(GIT))
        rules = tree.contents(listing.where(F.col("path") == ROOT_FILE), self.root).withColumn("text", F.expr("make_valid_utf8(CAST(content AS STRING))"))
        listing = without_ignored(listing, load_rules(rules, ROOT_FILE, root_only=True))
        out = F.col("size") > self.conf.max_filesize_mb << 20
        if self.conf.max_index_mb:
            beyond = C.first_beyond(listing.select("path", F.when(out, 0).otherwise(F.col("size")).alias("size")), self.conf.max_index_mb << 20)
            out |= F.coalesce(F.col("path") >= beyond, F.lit(False))
        return listing.where(~out), listing.where(out)

    def changes(self) -> DataFrame | None:
        """What differs from the index now, as delta rows; shards with enough of it are written anew. None if nothing does."""
        listing, _ = self._listing()
        delta = checkpointed(rescan(self.index.table("files").select("path", "size", "mtime_ns"), listing, self.root, 1, self.conf))
        n = delta.count()
        if n >= self.conf.overflow:
            self.build()
            return None
        if n >= self.conf.rebuild_threshold:
            self.index.clean()  # what the last compaction replaced; what this one replaces may still be read
            self.index.compact(delta, self.conf.rebuild_threshold)
        return delta if n else None

    def unindexed(self) -> DataFrame:
        """Files that the index does not hold, read now."""
        return C.route(tree.contents(self._listing()[1], self.root), EngineConf(max_filesize_mb=1 << 40, max_index_mb=0))


def rows_of(spark: SparkSession, a: argparse.Namespace, conf: EngineConf) -> DataFrame:
    """The rows of a request as one column ``value``."""
    tree.register(spark)
    at = Root(spark, a, conf)
    if a.op == "forget":
        return spark.createDataFrame([(at.root,)] if at.index is not None and at.index.forget() else [], "value string")
    indexed = at.indexed() and not a.text  # the index has no binary files
    if a.op == "status":
        status = C.status(at.files()).withColumn("engine", F.lit("disk" if indexed else "memory")).withColumn("index_bytes", F.lit(at.index.size() if indexed else 0)).withColumn("settings", F.lit(",".join(conf.overrides())))
        return S.as_json(status)
    scope = dict(subtree=at.subtree, globs=a.globs, exclude=a.exclude, include=a.include, gitignore=a.gitignore, hidden=a.hidden, max_filesize=a.max_filesize, text=a.text)
    delta = at.changes() if indexed and a.sync else None
    if a.op == "search":
        options = dict(nocase=a.nocase, fixed=a.fixed, mode=a.mode, max_columns=max(0, a.max_columns), **scope)
        rows = at.index.search(a.what, delta=delta, rest=at.unindexed(), **options) if indexed else S.search(at.files(), a.what, **options)
        if a.mode != "matches":
            return S.as_json(rows) if a.json else rows.selectExpr("path AS value" if a.mode == "files" else "concat(path, ':', count) AS value")
        if a.json:
            return S.as_events(rows, a.limit)
        return S.as_text(rows.limit(a.limit) if a.limit else rows)
    if a.op == "refs":
        rows = at.index.references(a.what, delta, **scope) if indexed else Y.find_references(S.scoped(at.files(), **scope), a.what)
        rows = rows.limit(a.limit) if a.limit else rows
    else:
        if indexed:
            defs = at.index.definitions(delta)
            now = at.index.table("files") if delta is None else overlay(at.index.table("files"), delta)
            defs = defs.join(S.scoped(now, **scope).select(F.col("_root_path").alias("path")), "path", "left_semi")
            if a.op == "symbols" and now.where(F.col("path") == a.what).isEmpty():
                raise FileNotFoundError(a.what)
        else:
            inside = S.scoped(at.files(), **scope)
            defs = Y.outline(inside, a.what) if a.op == "symbols" else Y.definitions(inside)
        rows = Y.find_definitions(defs, a.what, a.nocase) if a.op == "def" else defs.where(F.col("path") == a.what).orderBy("line", "name")
    return S.as_json(rows) if a.json else Y.as_text(rows)


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    try:
        a = arguments(argv)
        spark = spark or SparkSession.builder.appName("dredge").getOrCreate()
        found = False
        for row in rows_of(spark, a, EngineConf.load()).toLocalIterator():
            found = found or not row["value"].startswith('{"type":"done"')
            print(row["value"])
        return 0 if found else 1
    except (ValueError, OSError, argparse.ArgumentError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
