"""What the operators share: reading tables, words, stable numbers and checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dredge.sources.corpus import spread
from dredge.storage import checkpointed, shared_folder

__all__ = ["checkpointed", "documents", "id_crc", "n_words", "quoted", "shared_folder", "split_mod", "table", "words"]

#: A word, everywhere in this subpackage. ``bytes.split()`` splits at exactly these separators too.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named table, pruned to the given columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents; a scan of fewer partitions than cores is dealt over the cores."""
    return spread(table(spark, sf_dir, "documents", *columns))


def id_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def split_mod(remainder_of: int) -> Column:
    """The fold number of a document: crc32(doc_id as text) mod ``remainder_of``."""
    return id_crc() % remainder_of


def quoted(name: str) -> str:
    """A column's name as an expression, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"
