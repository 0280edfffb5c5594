"""Table registry: every driver table is one Parquet path below a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table as a lazy scan; unknown names fail at once."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(rows: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """Small scans dealt evenly to all cores.

    A file with one row group is one task however many cores wait.  Only a scan
    below ``split_bytes`` for each core, in fewer splits than cores, is dealt
    out; larger inputs keep their splits and are not shuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= split_bytes * cores or rows.rdd.getNumPartitions() >= cores:
        return rows
    return rows.repartition(cores)
