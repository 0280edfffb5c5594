"""Evidence operators: quote verification, merging, boilerplate, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .claims import normalise_nfkc


def verify_status(quote: Column, page: Column) -> Column:
    """How a quote stands in its page: too_short (under 12 characters), exact,
    exact_words (its letters and digits, 12 characters or more, whatever lies
    between), near (85% of its five-word runs, six words or more), failed."""
    q, p = T.containment_form(quote), T.containment_form(page)
    return status_of(q, p, T.letters_and_digits(q), T.letters_and_digits(p))


def status_of(q: Column, p: Column, qw: Column | None, pw: Column | None) -> Column:
    """``verify_status`` on forms; without letter-and-digit forms (the rule of
    extraction) there is no exact_words."""
    grams = T.shingles(F.split(q, " "), 5)
    near = (F.size(F.split(q, " ")) >= 6) & (F.size(F.filter(grams, lambda g: F.contains(p, g))) * 100 >= F.size(grams) * 85)
    out = F.when(F.length(q) < T.SHORTEST_QUOTE, "too_short").when(p.contains(q), "exact")
    if qw is not None:
        out = out.when((F.length(qw) >= T.SHORTEST_QUOTE) & pw.contains(qw), "exact_words")
    return out.when(near, "near").otherwise("failed")


def verify_quotes(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """(quote_id, page_id, status, extract_status) for every pair that shares a
    five-word run, by the rule of publishing and by that of extraction.  Only
    pages of some pair are folded, before they meet their quotes."""
    pairs = candidate_pages(quotes, pages)
    p = pages.join(pairs.select("page_id").distinct(), "page_id", "left_semi").select("page_id", normalise_nfkc(F.col("text")).alias("text"))
    p = p.select("page_id", T.containment_form(F.col("text")).alias("p"), T.extraction_form(F.col("text")).alias("pe")).withColumn("pw", T.letters_and_digits(F.col("p")))
    q = quotes.select("quote_id", normalise_nfkc(F.col("quote")).alias("quote"))
    q = q.select("quote_id", T.containment_form(F.col("quote")).alias("q"), T.extraction_form(F.col("quote")).alias("qe")).withColumn("qw", T.letters_and_digits(F.col("q")))
    joined = pairs.join(p, "page_id").join(q, "quote_id")
    return joined.select("quote_id", "page_id", status_of(F.col("q"), F.col("p"), F.col("qw"), F.col("pw")).alias("status"),
                         status_of(F.col("qe"), F.col("pe"), None, None).alias("extract_status"))


def candidate_pages(quotes: DataFrame, pages: DataFrame, size: int = 5) -> DataFrame:
    """(quote_id, page_id) pairs that share a run of ``size`` words: an equi-join
    of hashed runs in place of a containment join of all pairs."""
    q = quotes.select("quote_id", F.explode(F.array_distinct(T.gram_hashes(T.words("quote"), size))).alias("gram"))
    p = pages.select("page_id", F.explode(T.gram_hashes(T.words("text"), size)).alias("gram"))
    return p.join(q, "gram").select("quote_id", "page_id").distinct()


def merge_statements(rows: DataFrame, code: str, statement: str, source: str, order: list[str]) -> DataFrame:
    """One row per (code, statement under its merge key): the first record, its
    sources sorted and counted."""
    keyed = rows.withColumn("merge_key", T.merge_key(F.col(statement))).filter(F.col("merge_key") != "")
    return keyed.groupBy(code, "merge_key").agg(
        F.min_by(statement, F.struct(*order)).alias("statement"), F.min(order[0]).alias("first_seen"),
        F.array_join(F.array_sort(F.collect_set(source)), ",").alias("sources"), F.count(F.lit(1)).alias("n_records"),
    )


def boilerplate_lines(pages: DataFrame, host: str, page: str, text: str, share: float = 0.4, least_pages: int = 5, longest: int = 300) -> DataFrame:
    """Lines that at least ``share`` of a host's pages hold, on hosts of
    ``least_pages`` or more; long lines never count."""
    lines = (
        pages.select(F.col(host).alias("host"), F.col(page).alias("page"), F.explode(F.split(text, "\n")).alias("line"))
        .withColumn("line", F.trim("line")).filter((F.col("line") != "") & (F.length("line") < longest)).distinct()
    )
    counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_pages"))
    totals = pages.groupBy(F.col(host).alias("host")).agg(F.countDistinct(page).alias("host_pages"))
    return counts.join(totals, "host").filter((F.col("host_pages") >= least_pages) & (F.col("n_pages") >= share * F.col("host_pages")))


def clean_pages(pages: DataFrame, host: str, page: str, text: str, **rule) -> DataFrame:
    """Pages without boilerplate lines, lines in order, repeats in a row once."""
    drop = boilerplate_lines(pages, host, page, text, **rule).select("host", "line")
    lines = pages.select(F.col(host).alias("host"), F.col(page).alias("page"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.trim("line")).filter(F.col("line") != "").join(drop, ["host", "line"], "left_anti")
    order = Window.partitionBy("page").orderBy("pos")
    kept = lines.withColumn("prev", F.lag("line").over(order)).filter(F.col("prev").isNull() | (F.col("prev") != F.col("line")))
    return kept.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("clean"))


def coverage(rows: DataFrame, code: str, host: str, entity: str, fail: int, warn: int) -> DataFrame:
    """Units, distinct hosts and entities of each category, with a verdict."""
    return rows.groupBy(F.col(code).alias("code")).agg(
        F.count(F.lit(1)).alias("units"), F.countDistinct(host).alias("hosts"), F.countDistinct(entity).alias("entities"),
    ).withColumn("verdict", F.when(F.col("units") < fail, "FAIL").when(F.col("units") < warn, "WARN").otherwise("OK"))


def expected_items(items: DataFrame, rows: DataFrame, name: str, text: str) -> DataFrame:
    """Which expected names occur as whole words in any text: an equi-join on
    words, since names here are single words."""
    seen = rows.select(F.explode(F.array_distinct(T.words(F.col(text)))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n_units"))
    return items.select(F.col(name).alias("item"), F.lower(name).alias("word")).join(seen, "word", "left").select(
        "item", F.col("n_units").isNotNull().alias("found"), F.coalesce("n_units", F.lit(0)).alias("n_units"))
