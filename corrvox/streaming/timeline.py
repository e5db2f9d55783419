"""Worker event logs as a stream (an extension: runs are batches, their logs may be watched while they grow)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "worker int, ev string, tile long, t0 double, t1 double, points long, bytes long"


def read_events(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """Rows of JSON-lines logs, as a table or as a stream of the files that appear."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(SCHEMA).json(folder)


def rates(events: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Points, tiles and bytes by worker and window of event time; events later than ``late`` are left out of a stream."""
    e = events.withColumn("at", F.timestamp_micros((F.col("t1") * 1_000_000).cast("long"))).withWatermark("at", late)
    solve, read = F.col("ev") == "solve", F.col("ev") == "read"
    return e.groupBy(F.window("at", window).alias("span"), "worker").agg(
        F.sum(F.when(solve, F.col("points")).otherwise(0)).alias("points"), F.count(F.when(solve, 1)).alias("tiles"),
        F.sum(F.when(read, F.col("bytes")).otherwise(0)).alias("bytes_read"), F.sum(F.when(solve, F.col("t1") - F.col("t0")).otherwise(0.0)).alias("solve_s"),
    ).select(F.col("span.start").alias("start"), "worker", "points", "tiles", "bytes_read", "solve_s")
