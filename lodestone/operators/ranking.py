"""Search: postings, BM25, dense top-k, damped fusion, quotas, reserved seats."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import cut
from .windows import ranks_within


def postings(units: DataFrame, unit: str, fields: dict[str, float], terms: DataFrame, allowed: Column) -> DataFrame:
    """(unit, term, f, length, allowed) in one scan: weighted frequency over the
    fields of each term that ``terms`` asks for, the unit's number of tokens, and
    whether it may be a result.  A unit without such a term has a row without one."""
    split = units.select(F.col(unit).alias("unit"), allowed.alias("allowed"), *[T.words(F.coalesce(F.col(name), F.lit(""))).alias(f"w{i}") for i, name in enumerate(fields)])
    words = [F.col(f"w{i}") for i in range(len(fields))]
    tokens = split.select("unit", "allowed", *[F.size(w).alias(f"n{i}") for i, w in enumerate(words)], F.posexplode(F.concat(*words)).alias("pos", "term"))
    upto, weight = F.lit(0), None
    for i, share in enumerate(fields.values()):
        upto = upto + F.col(f"n{i}")
        inside = F.col("pos") < upto
        weight = F.when(inside, F.lit(float(share))) if weight is None else weight.when(inside, F.lit(float(share)))
    asked = terms.select("term").distinct().withColumn("asked", F.lit(True))
    kept = tokens.withColumns({"length": upto, "weight": weight}).join(asked, "term", "left").filter(F.col("asked") | (F.col("pos") == 0))
    return kept.groupBy("unit", F.when(F.col("asked"), F.col("term")).alias("term")).agg(
        F.sum("weight").alias("f"), F.max("length").alias("length"), F.max("allowed").alias("allowed"))


def bm25(index: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Top ``k`` units of each query (qid, term) by BM25 with floored idf.

    Statistics cover the whole index; units that are not allowed are no results.
    The index is written once: three readers share it.  Only postings of query
    terms are there, so it is short; the last filter is pushed into the sort as a
    group limit.
    """
    index = cut(index, "postings")
    found = index.filter(F.col("term").isNotNull())
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    mean = index.groupBy("unit").agg(F.max("length").alias("length")).agg(F.avg("length").alias("mean_length"), F.count(F.lit(1)).alias("n"))
    hits = found.filter("allowed").join(df.join(queries, "term"), "term").crossJoin(F.broadcast(mean))  # one row
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    scored = hits.withColumn("part", part).groupBy("qid", "unit").agg(F.round(F.sum("part"), 6).alias("score"))
    return top(scored, "qid", "score", "unit", k)


def dense(vectors: DataFrame, queries: DataFrame, k: int, own: bool = False, rows_per_shard: int = 50_000, queries_per_block: int = 2_000) -> DataFrame:
    """Top ``k`` of all vectors (unit, v) but its own for each query (qid, q), by
    dot product in double precision; with ``own`` only those of its label.

    Queries visit the vectors in blocks, shard by shard, and each pair of block
    and shard is one matrix product; ``k`` results of each leave it.
    """
    spark = vectors.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-vectors.count() // rows_per_shard))
    blocks = max(1, -(-queries.count() // queries_per_block))

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"qid": [], "unit": [], "score": []}
        if len(left) and len(right):
            units, matrix = left["unit"].to_numpy(), np.array(left["v"].tolist(), np.float64)
            for row in right.itertuples(index=False):
                score = np.round(matrix @ np.asarray(row.q, np.float64), 6)
                score[units == row.qid] = -np.inf
                if own:
                    score[left["label"].to_numpy() != row.label] = -np.inf
                least = np.partition(score, max(len(score) - k, 0))[max(len(score) - k, 0)]
                at = np.flatnonzero((score >= least) & np.isfinite(score))
                at = at[np.lexsort((units[at], -score[at]))[:k]]
                out["qid"] += [row.qid] * len(at)
                out["unit"] += units[at].tolist()
                out["score"] += score[at].tolist()
        return pd.DataFrame(out)

    left = vectors.filter(F.col("v").isNotNull()).withColumn("shard", F.pmod(F.xxhash64("unit"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.filter(F.col("q").isNotNull()).withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(search, "qid long, unit long, score double")
    return top(found, "qid", "score", "unit", k)


def top(scored: DataFrame, group: str, score: str, tie: str, k: int) -> DataFrame:
    """The ``k`` largest scores of each group, ranked from 1, ties by ``tie``."""
    order = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def damped_fusion(hits: DataFrame, smooth: int = 60, agreement: float = 0.2) -> DataFrame:
    """Fuse ranked lists (qid, half, unit, rank, weight): a unit's best part
    weight / (smooth + rank) plus ``agreement`` times its other parts."""
    part = F.col("weight") / (smooth + F.col("rank"))
    return hits.withColumn("part", part).groupBy("unit").agg(
        F.max("part").alias("best"), F.sum("part").alias("total"), F.count(F.lit(1)).alias("n_lists"),
    ).select("unit", F.round(F.col("best") + agreement * (F.col("total") - F.col("best")), 9).alias("score"), "n_lists")


def own_quota(main: DataFrame, own: DataFrame, k: int, least: int) -> DataFrame:
    """Merge two hit lists (qid, unit, score) to ``k`` per query with at least
    ``least`` rows of the query's own kind, the rest by score."""
    both = main.withColumn("own", F.lit(0)).unionByName(own.withColumn("own", F.lit(1))).groupBy("qid", "unit").agg(F.max("score").alias("score"), F.max("own").alias("own"))
    within = Window.partitionBy("qid", "own").orderBy(F.desc("score"), "unit")
    first = (F.col("own") == 1) & (F.row_number().over(within) <= least)
    choose = Window.partitionBy("qid").orderBy(F.desc("held"), F.desc("score"), "unit")
    chosen = both.withColumn("held", first.cast("int")).withColumn("seat", F.row_number().over(choose)).filter(F.col("seat") <= k)
    return top(chosen.select("qid", "unit", "score", "own"), "qid", "score", "unit", k)


def interleave(hits: DataFrame, depth: int) -> DataFrame:
    """All first places, then all second places, down to ``depth``: each unit at
    its first occurrence."""
    first = Window.partitionBy("unit").orderBy("rank", "query_ord")
    kept = hits.filter(F.col("rank") <= depth).withColumn("rn", F.row_number().over(first)).filter("rn = 1")
    kept = cut(kept.select("unit", "rank", "query_ord"), "seats")
    # Seats of a rank are counted by stretches of queries; only the few ranks are
    # added up in one task.
    sizes = kept.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("rank", F.coalesce(before, F.lit(0)).alias("offset"))
    placed = ranks_within(kept, ["rank"], "query_ord").join(F.broadcast(offsets), "rank")  # one row for each rank
    return placed.select("unit", (F.col("offset") + F.col("place")).alias("seat"), "rank", "query_ord")
