"""The folder that the driver and all executors share, and tables cut from their lineage there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    Only where none is named and the master is local (tests), a temporary folder is made and set.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="dredge-checkpoint-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` in the shared folder, with its lineage cut there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def file_system(spark: SparkSession, folder: str):
    """The Hadoop file system of a folder, and its Path class."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def deleted(spark: SparkSession, folder: str) -> bool:
    """Delete a folder; whether there was one."""
    fs, path = file_system(spark, folder)
    return fs.exists(path(folder)) and fs.delete(path(folder), True)
