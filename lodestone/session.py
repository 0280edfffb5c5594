"""Session settings used by tests, the bench and the driver entry."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "lodestone", master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A session with AQE on and UTC time.  Cluster deployments pass their own
    master and let ``spark.sql.shuffle.partitions`` follow the input size
    (about 128 MB of shuffled data for each partition)."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.appName(app)
        .master(master or f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LODESTONE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
