"""Mixing sources to target weights: documents counted by exact length, a
bounded-knapsack fit of each source's budget, seeded selection by length count."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import cut

SPACE_WORD = r"[^\x20\x09-\x0D]+"
PARTS = 256


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, most: int = 200_000) -> np.ndarray:
    """How many documents of each length to take so that their lengths sum to
    ``budget`` as nearly as can be from below.

    The bulk is taken in proportion to ``counts``; what is left of the budget,
    at most ``most`` words (or the longest document if that is more), is filled
    by an exact subset-sum over the documents still free.
    """
    order = np.argsort(-lengths, kind="stable")
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    total = int((lengths * counts).sum())
    take = counts.copy()
    if budget < total:
        share = counts * (max(budget, 0) / total)
        take = np.minimum(np.floor(share).astype(np.int64), counts)
        left = int(budget - (lengths * take).sum())
        while left < 0:  # floating point may round a share up
            j = int(np.flatnonzero(take)[0])
            take[j] -= 1
            left += int(lengths[j])
        for j in np.argsort(-(share - take), kind="stable"):
            if take[j] < counts[j] and 0 < lengths[j] <= left:
                take[j] += 1
                left -= int(lengths[j])
        for j in range(len(lengths)):
            if left <= most:
                break
            if lengths[j]:
                more = min(int(counts[j] - take[j]), left // int(lengths[j]))
                take[j] += more
                left -= more * int(lengths[j])
        back = 0
        for j in np.flatnonzero((take > 0) & (lengths > 0))[:3]:  # room for the fit
            if left == 0 or left + back + lengths[j] > max(most, 2 * int(lengths[0])):
                break
            take[j] -= 1
            back += int(lengths[j])
        take += _subset_sum(lengths, counts - take, left + back)
    result = np.empty_like(take)
    result[order] = take
    return result


def _subset_sum(lengths: np.ndarray, free: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack by dynamic programming: ``via[s]`` is the first item by
    which the sum s came into reach, so walking back uses each item once."""
    used = np.zeros_like(free)
    if budget <= 0:
        return used
    reach, via, items = np.zeros(budget + 1, bool), np.full(budget + 1, -1, np.int64), []
    reach[0] = True
    for j in np.flatnonzero((free > 0) & (lengths > 0) & (lengths <= budget)):
        left, size = min(int(free[j]), budget // int(lengths[j])), 1
        while left > 0 and not reach[budget]:
            n = min(size, left)
            weight = n * int(lengths[j])
            if weight > budget:
                break
            new = np.zeros(budget + 1, bool)
            new[weight:] = reach[:-weight]
            new &= ~reach
            via[new] = len(items)
            items.append((j, n, weight))
            reach |= new
            left, size = left - n, size * 2
        if reach[budget]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:
        j, n, weight = items[via[at]]
        used[j] += n
        at -= weight
    return used


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    target, size = float(pdf["target"].iloc[0]), int(pdf["source_size"].iloc[0])
    base = int(size > 0 and target >= size)
    budget = int(np.floor(target + 0.5)) - base * size
    extra = fit_counts(pdf["size"].to_numpy(), pdf["n"].to_numpy(), budget)
    return pdf[["no_source", "source_key", "size"]].assign(base=base, extra=extra)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Target words of each source from (no_source, source_key, source_size).

    Targets are proportional to the weights, stop at ``most`` times a source's
    size, and what is cut off goes to the others by weight.  With sources in
    order of size by weight, the first that its share does not fill settles the
    share of all after it: one pass of running sums instead of rounds.
    """
    named = Window.orderBy("no_source", "source_key")
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("w", F.get(table, F.pmod(F.row_number().over(named) - 1, F.lit(len(weights)))))
    ranked = ranked.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    line = Window.orderBy("ratio", "no_source", "source_key")
    before, everything = line.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    ranked = ranked.withColumn("rate", (
        F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    ranked = ranked.withColumn("open_ratio", F.min(F.when(F.col("ratio") >= F.col("rate"), F.struct("ratio", "rate"))).over(everything))
    return ranked.select(
        "no_source", "source_key", "source_size",
        F.when(F.col("open_ratio").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("open_ratio.rate") * F.col("w"))).alias("target"),
    )


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """How many words the mix takes of each document.

    Returns one row per input row: doc_id, size (words; null text 0), source,
    source_size, target (of its source), taken (size times the copies taken, 0
    to 2).  Sources are ordered by code point with null last and weigh
    ``weights`` in turn.  A source whose target reaches its size gives every
    document once and the rest of the target by second copies.  Which documents
    of one length are taken follows a seeded hash of the id, so reruns agree;
    rows repeating an id are taken or left one by one, those with a null id too.
    Other columns are ignored whatever their names, an empty table gives an empty
    result, and a very long text is one large item.

    Only counts by (source, length) leave the rows: a source's fit sees one row
    per distinct length, and ranks are dealt within 256 parts of a length, so
    no source, length or id gathers its rows in one task.
    """
    sized = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(SPACE_WORD)), F.lit(0)).cast("long").alias("size"),
        )
        .withColumn("no_source", F.col("source").isNull())
        .withColumn("source_key", F.coalesce("source", F.lit("")))
        .withColumn("draw", F.xxhash64(F.lit(seed), "doc_id"))
        .withColumn("part", F.pmod("draw", F.lit(PARTS)).cast("int")),
        "mix-sizes",
    )
    parts = cut(sized.groupBy("no_source", "source_key", "size", "part").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    counts = parts.groupBy("no_source", "source_key", "size").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("no_source", "source_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = cut(source_targets(totals, weights, share, most), "mix-targets")
    fitted = (
        counts.join(targets, ["no_source", "source_key"])
        .groupBy("no_source", "source_key")
        .applyInPandas(_fit_source, "no_source boolean, source_key string, size long, base long, extra long")
    )
    earlier = Window.partitionBy("no_source", "source_key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    quota = (
        parts.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .join(fitted, ["no_source", "source_key", "size"])
        .select("no_source", "source_key", "size", "part", "base",
                F.greatest(F.lit(0), F.least("n", F.col("extra") - F.col("earlier"))).alias("quota"))
    )
    dealt = Window.partitionBy("no_source", "source_key", "size", "part").orderBy("draw", "doc_id")
    return (
        sized.join(quota, ["no_source", "source_key", "size", "part"])
        .join(targets, ["no_source", "source_key"])
        .withColumn("copies", F.col("base") + (F.row_number().over(dealt) <= F.col("quota")).cast("long"))
        .select("doc_id", "size", "source", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
    )
