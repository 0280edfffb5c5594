"""Ordered operators: caps, budgets, rounds, batches, gaps, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cap_per_key(rows: DataFrame, key: str | list[str], order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows of each key: one cap alone is an exact window, and
    the filter on the row number limits each sort before the shuffle."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("place") <= cap)


def budget_fill(rows: DataFrame, group: str, order: list[Column], cost: str, budget: float, cap: int) -> DataFrame:
    """Rows of each group in order, at most ``cap``, while the running cost stays
    within the budget."""
    line = Window.partitionBy(group).orderBy(*order)
    placed = rows.withColumn("place", F.row_number().over(line)).filter(F.col("place") <= cap)
    spent = F.sum(cost).over(line.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("spent", F.round(spent, 2)).filter(F.col("spent") <= budget)


def ranks_within(rows: DataFrame, parts: list[str], order: str, width: int = 65_536) -> DataFrame:
    """``place``: 1-based ranks of each part in order of an integral column without
    repeats there.  Counts of each stretch of ``width`` values give the offsets, so
    no part is sorted in one task."""
    placed = rows.withColumn("stretch", F.floor(F.col(order) / width).cast("long"))
    counts = placed.groupBy(*parts, "stretch").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*parts).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*parts, "stretch", F.coalesce(before, F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy(*parts, "stretch").orderBy(order))
    return placed.join(offsets, [*parts, "stretch"]).withColumn("place", (F.col("offset") + within).cast("long")).drop("stretch", "offset")


def round_robin(rows: DataFrame, item: str, order: str, size: int) -> DataFrame:
    """Batches by rounds: the i-th row of every item belongs to round i; a round
    is cut into batches of ``size`` and its last batch is not filled up."""
    turn = F.row_number().over(Window.partitionBy(item).orderBy(order))
    rounds = ranks_within(rows.withColumn("round", turn.cast("long")), ["round"], item)
    return rounds.withColumn("batch", F.floor((F.col("place") - 1) / size).cast("long")).drop("place")


def fixed_batches(rows: DataFrame, part: str, order: str, size: int) -> DataFrame:
    """Batches of ``size`` within each part, in order."""
    placed = ranks_within(rows, [part], order)
    return placed.withColumn("batch", F.floor((F.col("place") - 1) / size).cast("long")).withColumn("index", ((F.col("place") - 1) % size).cast("long")).drop("place")


def active_minutes(log: DataFrame, key: str, ts: str, gap_seconds: int = 600) -> DataFrame:
    """Minutes of activity: gaps between neighbouring events, each counted up to
    ``gap_seconds``."""
    before = F.lag(ts).over(Window.partitionBy(key).orderBy(ts))
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    return log.withColumn("gap", F.least(gap, F.lit(gap_seconds * 1_000_000))).groupBy(key).agg(
        F.round(F.coalesce(F.sum("gap"), F.lit(0)) / 60e6, 6).alias("minutes"), F.count(F.lit(1)).alias("n_events"))


def first_appearance_numbers(rows: DataFrame, chapter: str, source: str, pos: str) -> DataFrame:
    """Footnote numbers: sources of a chapter numbered by first appearance."""
    first = rows.groupBy(chapter, source).agg(F.min(pos).alias("first_pos"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy(chapter).orderBy("first_pos", source)).cast("long"))


def dense_ids(rows: DataFrame, pos: str, width: int = 65_536) -> DataFrame:
    """Dense 0-based row ids in order of an integral ``pos``, without sorting all
    rows in one task: counts of each stretch of ``width`` positions give the
    offsets, ranks are taken within stretches.  Null positions come last."""
    last = F.lit((1 << 63) - 1)  # no position is in that stretch
    placed = rows.withColumn("stretch", F.coalesce(F.floor(F.col(pos) / width).cast("long"), last))
    counts = placed.groupBy("stretch").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("offset", before).select("stretch", "offset")
    within = F.row_number().over(Window.partitionBy("stretch").orderBy(pos))
    return placed.join(offsets, "stretch").withColumn("row_id", (F.col("offset") + within - 1).cast("long")).drop("stretch", "offset")


def seeded_sample(rows: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows of each stratum in a reproducible random order."""
    return cap_per_key(rows.withColumn("draw", F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))), stratum, [F.col("draw"), F.col(key)], n)


def pacing(rows: DataFrame, host: str, order: list[Column], delay: int) -> DataFrame:
    """Earliest start of each request in seconds, hosts waiting ``delay`` between."""
    return rows.withColumn("start_s", ((F.row_number().over(Window.partitionBy(host).orderBy(*order)) - 1) * delay).cast("long"))
