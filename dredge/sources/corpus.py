"""Corpora as ``files`` tables: from document tables, and from decoded and routed file contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dredge.conf import EngineConf
from dredge.functions.text import PROBE_BYTES, decode_utf16
from dredge.operators.ranged import in_ranges, running


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than cores (one small file, say) dealt over the cores; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def _files(df: DataFrame, path: Column, text: str) -> DataFrame:
    return df.select(path.alias("path"), F.octet_length(text).cast("long").alias("size"), F.col(text).alias("text")).where("text IS NOT NULL")


def _path(*parts: Column | str) -> Column:
    """The parts put together; a null part is written as null, so no row loses its path."""
    return F.concat(*[F.coalesce(F.col(p).cast("string"), F.lit("null")) if isinstance(p, str) else p for p in parts])


def document_path() -> Column:
    """source/lang/doc_id.txt."""
    return _path("source", F.lit("/"), "lang", F.lit("/"), "doc_id", F.lit(".txt"))


def document_files(docs: DataFrame) -> DataFrame:
    """documents as files source/lang/doc_id.txt."""
    return _files(docs, document_path(), "text")


def page_files(pages: DataFrame) -> DataFrame:
    """pages as files pages/page_id.html."""
    return _files(pages, _path(F.lit("pages/"), "page_id", F.lit(".html")), "html")


def conversation_files(chats: DataFrame) -> DataFrame:
    """conversations as files conv/conv_id/turn.role."""
    return _files(chats, _path(F.lit("conv/"), "conv_id", F.lit("/"), "turn", F.lit("."), "role"), "text")


def first_beyond(sizes: DataFrame, budget: int) -> Column:
    """The first path (a scalar) at which the sizes of rows (path, size), added up in path order, exceed the budget."""
    ranged = in_ranges(sizes, ["path"])
    add = F.coalesce(F.col("before"), F.lit(0)) + F.col("inside")
    spent = running(ranged, ["path"], "spent", F.sum("size"), F.sum("size"), F.sum("total"), add)
    return spent.where(F.col("spent") > budget).agg(F.min("path").alias("path")).scalar()


def route(files: DataFrame, conf: EngineConf | None = None) -> DataFrame:
    """Adds ``text`` (decoded) and ``route`` to rows of path, size, content.

    Larger than the file limit: large; beyond the byte budget: budget; NUL in the probed bytes after
    decoding: binary; unreadable (null content): error; else indexed. The budget is spent in path order
    on files that are not large. Sizes rise with the path, so one path divides what fits from what does
    not: it is found among (path, size) alone and contents are not shuffled.
    """
    conf = conf or EngineConf()
    large = F.col("size") > conf.max_filesize_mb << 20
    out = files.withColumn("_large", large)
    if conf.max_index_mb:
        beyond = first_beyond(files.select("path", F.when(large, 0).otherwise(F.col("size")).alias("size")), conf.max_index_mb << 20)
        out = out.withColumn("_over", F.coalesce(F.col("path") >= beyond, F.lit(False)))
    else:
        out = out.withColumn("_over", F.lit(False))
    out = out.withColumn("text", decode_utf16("content"))
    utf16 = F.expr("substring(content, 1, 2) IN (X'FFFE', X'FEFF')")
    binary = F.when(utf16, F.locate("\0", F.substring("text", 1, PROBE_BYTES)) > 0).otherwise(F.expr(f"locate(X'00', substring(content, 1, {PROBE_BYTES})) > 0"))
    kind = (
        F.when(F.col("content").isNull(), "error")
        .when(F.col("_large"), "large")
        .when(binary, "binary")
        .when(F.col("_over"), "budget")
        .otherwise("indexed")
    )
    return out.withColumn("route", kind).drop("_large", "_over")


def searchable(files: DataFrame, text: bool = False) -> DataFrame:
    """Files that a search reads: all but errors, and binaries only if ``text`` is set."""
    if "route" not in files.columns:
        return files
    return files.where("route <> 'error'") if text else files.where("route NOT IN ('error', 'binary')")


def status(files: DataFrame, *roots: str) -> DataFrame:
    """Files, bytes and skip counters, per root column if one is named."""
    one = lambda r: F.count_if(F.col("route") == r)
    return files.groupBy(*roots).agg(
        one("indexed").alias("files"),
        F.coalesce(F.sum(F.when(F.col("route") == "indexed", F.col("size"))), F.lit(0)).cast("long").alias("bytes"),
        one("large").alias("large"),
        one("budget").alias("budget"),
        one("binary").alias("binary"),
        one("error").alias("errors"),
        F.count_if(F.col("route").isin("large", "budget", "binary")).alias("stream"),
    )
