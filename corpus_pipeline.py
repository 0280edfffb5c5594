"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns what it kept; the result is
written as Parquet and read again as the next stage's input.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontam, langid, line_dedup, mixing, near_dedup
from lodestone.llm._shared import cut, join_rows

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language; those that the classifier rejects go."""
    found = langid.identify(docs, langid.fit(docs), keep=COLUMNS)
    return found.filter(~F.col("rejected")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that ten or more documents share."""
    found = line_dedup.drop_repeated_lines(docs, keep=("lang", "source"))
    return found.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest id."""
    gone = near_dedup.near_duplicates(docs).filter(~F.col("is_kept")).select("doc_id", "th").distinct()
    keyed = docs.withColumn("th", F.xxhash64(F.col("text")))
    return join_rows(keyed, gone, "left_anti", hash_right=True).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window: here one item is a leak already."""
    bench = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    found = decontam.decontaminate(docs, bench, min_items=1, keep=COLUMNS)
    return found.filter(~F.col("contaminated")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mixing.mix_sources(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("mixing", mix),
]

#: Classifier, samples and subset sums are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to shared storage and reread."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
