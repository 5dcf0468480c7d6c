"""Cutting the lineage of iterative jobs by tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; in local mode, where all share one disk, one of our own if it names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def removed_at_end(spark: SparkSession, path: str) -> None:
    """Has Hadoop's file system remove a folder when the driver ends."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)


def cut(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: no later job recomputes or loses its rows.

    The table is removed when the application ends.
    """
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    removed_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
