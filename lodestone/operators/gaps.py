"""Second-pass queries for what the first pass left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def term_counts(units: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """In how many units each wanted term stands, and how many units there are."""
    words = units.select(F.explode(F.array_distinct(T.words(F.col(text), 4))).alias("term"))
    n = units.agg(F.count(F.lit(1)).alias("n_units"))
    return words.join(wanted.select("term").distinct(), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n))  # one row


def plan_gaps(
    entries: DataFrame, counts: DataFrame, fits: DataFrame, covered: DataFrame, asked: DataFrame,
    least_df: int = 3, anchor_floor: int = 25, anchor_share: float = 0.006, query_share: float = 0.05, least_fit: int = 10,
    most_terms: int = 12, most_queries: int = 2, most_overlap: float = 0.6,
) -> DataFrame:
    """Entries of a profile whose rare words name things that nothing found holds.

    ``entries`` (code, entry, blind, facet_rank, text), ``counts`` (term, df,
    n_units), ``fits`` (term, fit: named things that carry it), ``covered``
    (code, term: in what the first pass chose), ``asked`` (code, query, text: the
    first pass' queries, a few for each code).

    An entry's lead is its best fitting term that is rare and uncovered (ties to
    the smaller term); entries that no query of the first pass reads come first,
    then the better fit, then the order of the profile.  Its query holds the
    rarest terms in the order of the entry; one that mostly repeats a query asked
    before is left out.  Returns code, place, entry, lead, fit, query.
    """
    words = entries.select("code", "entry", F.posexplode(F.array_distinct(T.words(F.col("text"), 4))).alias("pos", "term"))
    known = words.join(counts, "term").filter(F.col("df") >= least_df)
    ceiling = F.greatest(F.lit(anchor_floor), F.floor(F.col("n_units") * anchor_share))
    usable = known.filter(F.col("df") <= F.greatest(ceiling, F.floor(F.col("n_units") * query_share)))
    leads = (
        known.filter(F.col("df") <= ceiling).join(covered.select("code", "term").distinct(), ["code", "term"], "left_anti").join(fits, "term")
        .filter(F.col("fit") >= least_fit).groupBy("code", "entry").agg(F.min(F.struct(-F.col("fit"), "term")).alias("best"))
        .select("code", "entry", (-F.col("best.col1")).alias("fit"), F.col("best.term").alias("lead"))
    )
    rare = Window.partitionBy("code", "entry").orderBy("df", "term")
    kept = usable.join(leads, ["code", "entry"], "left_semi").withColumn("rn", F.row_number().over(rare)).filter(F.col("rn") <= most_terms)
    # An entry holds at most most_terms terms here, so the lists are short.
    queries = kept.groupBy("code", "entry").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("t")).select("code", "entry", F.transform("t", lambda x: x["term"]).alias("terms"))
    before = asked.select("code", F.array_distinct(T.words(F.col("text"), 4)).alias("theirs"))
    repeats = queries.join(before, "code").filter(F.size(F.array_intersect("terms", "theirs")) / F.size("terms") > most_overlap)
    fresh = queries.join(repeats.select("code", "entry").distinct(), ["code", "entry"], "left_anti")
    order = Window.partitionBy("code").orderBy(F.desc("blind"), F.desc("fit"), "facet_rank", "entry")
    ranked = fresh.join(leads, ["code", "entry"]).join(entries.select("code", "entry", "blind", "facet_rank"), ["code", "entry"]).withColumn("place", F.row_number().over(order).cast("long"))
    return ranked.filter(F.col("place") <= most_queries).select("code", "place", "entry", "lead", "fit", F.array_join("terms", " ").alias("query"))
