"""From raw documents to packed training sequences: five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns the documents that it lets through with their own
columns; the last one returns where each piece of each document lies.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from dredge.llm import minhash, mixing, packing, quality_llr, quality_qda
from dredge.llm.common import shared_folder, table
from dredge.storage import deleted


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: enough words, not too many repeated, a likely text. Null and empty texts go; equal rows share a verdict; an empty table stays empty."""
    return quality_llr.keep_documents(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores high enough, null texts scored as empty ones. Without labels of both kinds all have one score; an empty table stays empty."""
    return quality_qda.keep_documents(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest id. Texts without words and rows with a null id stay; of equal rows one stays."""
    return minhash.keep_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out, so that sources have their weights. Null text is no words and is left out; a null source is a source."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document. A null or empty text is its end id alone; equal rows are packed each; an empty table gives no rows."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near dedup", near_dedup),
    ("mixing", mix),
    ("packing", pack),
]

#: Fitted models, similarity components and tokenization have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet in the shared folder and read again.

    A stage's checkpoints and its input go once its result is written, so at most two results lie there at a
    time. A session makes one run at a time.
    """
    docs, base = table(spark, sf_dir, "documents"), shared_folder(spark)
    folder, sc = f"{base}/pipeline-{uuid.uuid4().hex}", spark.sparkContext
    try:
        for k, (_, stage) in enumerate(STAGES):
            sc.setCheckpointDir(f"{folder}/work")
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
            for done in ("work", k - 1):
                deleted(spark, f"{folder}/{done}")
            docs = spark.read.parquet(f"{folder}/{k}")
    finally:
        sc.setCheckpointDir(base.rpartition("/")[0])
    return docs
