"""Streaming analogues on the fetch log: resume by key, sessions, counts.

The batch system resumes by remembering keys that are done; on a stream that is
deduplication within a watermark, and gaps between fetches are session windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1, late: str = "1 hour") -> DataFrame:
    """Parquet files of events as they arrive; rows later than ``late`` are lost."""
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def once_per_key(stream: DataFrame) -> DataFrame:
    """Each event id once; a repeat within the watermark is dropped."""
    return stream.dropDuplicatesWithinWatermark(["event_id"])


def sessions(stream: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """Activity of each user between gaps."""
    return stream.groupBy("user_id", F.session_window("ts", gap)).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("user_id", "session_window.start", "session_window.end", "n", "total")


def status_counts(stream: DataFrame, width: str = "1 hour") -> DataFrame:
    return stream.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("start"), "event_type", "n")
