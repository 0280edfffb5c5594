"""Rows-only queries: sentences, claims, chunks, embeddings."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import functions as F

from ..operators import claims as C
from ..operators import grounding as G
from ..sources.tables import table


def sentence_split(spark, d):
    return C.sentence_rows(table(spark, d, "conversations"), ["conv_id", "turn"], "text")


def claim_check(spark, d):
    """Sentences of every assistant turn against the turn before as the unit that
    it cites and the one before that as the reader's own file."""
    t = table(spark, d, "conversations")
    before = lambda n, name: t.select("conv_id", (F.col("turn") + n).cast("int").alias("turn"), F.col("text").alias(name))
    rows = t.filter(F.col("role") == "assistant").join(before(1, "cited"), ["conv_id", "turn"], "left").join(before(2, "own"), ["conv_id", "turn"], "left")
    units = F.when(F.col("cited").isNull(), F.array().cast("array<struct<text:string>>")).otherwise(F.array(F.struct(F.col("cited").alias("text"))))
    found = rows.select("conv_id", "turn", F.explode(G.grounding(F.col("text"), units, F.array("own"))).alias("f"))
    return found.select("conv_id", "turn", "f.pos", F.md5("f.sentence").alias("sentence_md5"), F.array_join("f.findings", "|").alias("findings"), "f.grounded")


def chunk_pack(spark, d):
    return C.chunk_rows(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "pos", F.length("chunk").cast("long").alias("n"), F.md5("chunk").alias("chunk_md5"))


def sequence_ratio(spark, d):
    """Longest-matching-blocks ratio of neighbouring turns' words."""
    from pyspark.sql import Window

    t = table(spark, d, "conversations").withColumn("prev", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter(F.col("prev").isNotNull())

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x.split(), y.split(), autojunk=False).ratio() for x, y in zip(a, b)])

    return t.select("conv_id", "turn", F.round(ratio("text", "prev"), 6).alias("ratio"))


def stub_embeddings(spark, d):
    return table(spark, d, "benchmark").select("item_id", C.hashed_words(F.col("text")).alias("embedding"))


def folded_texts(spark, d):
    """NFKC and invisible characters: how many texts either changes."""
    t = table(spark, d, "documents").select("text", C.normalise_nfkc(F.col("text")).alias("n"), C.strip_invisible(F.col("text")).alias("s"))
    return t.agg(F.count_if(F.col("text") != F.col("n")).alias("nfkc_changes"), F.count_if(F.col("text") != F.col("s")).alias("invisible_changes"))


QUERIES = {f.__name__: f for f in (sentence_split, claim_check, chunk_pack, sequence_ratio, stub_embeddings, folded_texts)}
ORACLES: dict[str, str] = {}
