"""Sinks: units by kind, graph export, bundles with a manifest, index checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def check_units(units: DataFrame) -> DataFrame:
    """One row of violation counts; every one must be 0 before publishing."""
    ids = units.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = ids.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, 1).otherwise(0)), F.lit(0)).alias("repeated_ids"))
    rows = units.agg(
        F.count_if(F.col("unit_id").isNull() | (F.col("unit_id") == "")).alias("missing_ids"),
        F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("empty_texts"),
        F.count_if(F.coalesce("source_url", F.lit("")) == "").alias("missing_urls"),
    )
    return rows.crossJoin(repeated)


def publish_units(units: DataFrame, path: str) -> DataFrame:
    """Write units partitioned by kind and return counts by kind and category;
    violations abort before anything is written."""
    bad = {k: v for k, v in check_units(units).first().asDict().items() if v}
    if bad:
        raise ValueError(f"units not published: {bad}")
    units.write.mode("overwrite").partitionBy("kind").parquet(path)
    return units.sparkSession.read.parquet(path).groupBy("kind", "category_code").agg(F.count(F.lit(1)).alias("n"))


def export_graph(nodes: DataFrame, edges: DataFrame, path: str, most_sources: int = 5) -> None:
    """nodes and edges as CSV; source lists sorted and cut to ``most_sources``."""
    short = F.array_join(F.slice(F.array_sort("sources"), 1, most_sources), " ")
    nodes.withColumn("sources", short).write.mode("overwrite").option("header", True).csv(f"{path}/nodes")
    edges.write.mode("overwrite").option("header", True).csv(f"{path}/edges")


def export_bundle(parts: dict[str, DataFrame], path: str) -> DataFrame:
    """Each part as compressed JSON lines, and a manifest of files: name, bytes,
    sha256, readable as a DataFrame."""
    for name, rows in parts.items():
        rows.write.mode("overwrite").option("compression", "gzip").json(f"{path}/{name}")
    spark = next(iter(parts.values())).sparkSession
    return fingerprint(spark, [f"{path}/{name}" for name in parts])


def fingerprint(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Bytes and SHA-256 of every data file: equal fingerprints mean nothing to do."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(paths)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def results_by_category(rows: DataFrame, code: str, order: str) -> DataFrame:
    """One JSON array of results for each category, in rank order."""
    ordered = F.array_sort(F.collect_list(F.struct(order, *[c for c in rows.columns if c not in (code, order)])))
    return rows.groupBy(code).agg(F.to_json(ordered).alias("results"))


def cost_ledger(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """Calls (model, peak, tokens_in, tokens_out) priced per million tokens."""
    priced = calls.join(F.broadcast(rates), ["model", "peak"])
    cost = (F.col("tokens_in") * F.col("rate_in") + F.col("tokens_out") * F.col("rate_out")) / 1e6
    return priced.groupBy("model").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum(cost), 6).alias("cost"))
