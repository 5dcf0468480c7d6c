"""Structured streams over event tables: windows and sessions with watermarks. An extension of the library."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import shared_dir

LATE = "2 days"


def source(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A stream of a table's files, with the schema of what is there."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need an instant, in the session's zone


def daily_counts(events: DataFrame) -> DataFrame:
    w = F.window("ts", "1 day")
    return events.withWatermark("ts", LATE).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("start"), "n")


def user_sessions(events: DataFrame, gap: str = "2 days") -> DataFrame:
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", LATE).groupBy(s.alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def run_once(spark: SparkSession, folder: str, table: str, plan: Callable[[DataFrame], DataFrame], keys: list[str], mode: str = "update") -> DataFrame:
    """All that is there now through a stream, as a table in the shared folder: of each key the row that came last.

    mode: "update" gives windows as they stand, "append" only those that the watermark has closed. Either way the state
    of windows behind the watermark is dropped.
    """
    path = f"{shared_dir(spark)}/{uuid.uuid4()}"
    out = plan(source(spark, folder, table))

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")

    q = out.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rest = [c for c in out.columns if c not in keys]
    rows = spark.read.schema(out.withColumn("epoch", F.lit(0)).schema).parquet(f"{path}/rows")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("__last")).select(*keys, "__last.*")
