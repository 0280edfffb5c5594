"""Selection beyond single lists: themes, artefacts, gaps, relations, redirects."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import cut

# How a relation reads along its edge and against it.
PHRASING = (
    ("DIRECTS", "directs", "is directed by"), ("TEACHES", "teaches", "is taught by"), ("RESEARCHES", "researches", "is researched by"),
    ("OFFERED_BY", "is offered by", "offers"), ("PART_OF", "is part of", "includes"), ("HOSTS", "hosts", "is hosted by"), ("FUNDS", "funds", "is funded by"),
    ("PARTNERS_WITH", "partners with", "partners with"), ("MEMBER_OF", "is a member of", "has as a member"),
    ("AFFILIATED_WITH", "is affiliated with", "is affiliated with"), ("AWARDED", "was awarded", "was awarded to"), ("LOCATED_IN", "is located in", "contains"),
)


def relation_sentence(predicate: Column, direction: Column, anchor: Column, other: Column) -> Column:
    """One plain sentence in the direction the edge runs."""
    phrase = F.lower(F.replace(predicate, F.lit("_"), F.lit(" ")))
    for name, forward, _ in PHRASING:
        phrase = F.when(predicate == name, F.lit(forward)).otherwise(phrase)
    return F.when(direction == "in", F.concat_ws(" ", other, phrase, F.concat(anchor, F.lit(".")))).otherwise(F.concat_ws(" ", anchor, phrase, F.concat(other, F.lit("."))))


def relation_units(chains: DataFrame, prefix: str = "") -> DataFrame:
    """Chains (unit, predicate, direction, anchor, other, evidence, url) as units of
    their own: one for each sentence and address, with the units that lead to it.
    Chains without evidence or address cannot be checked and give none."""
    text = relation_sentence(F.col("predicate"), F.col("direction"), F.col("anchor"), F.col("other"))
    rows = chains.filter((F.coalesce(F.trim("evidence"), F.lit("")) != "") & (F.coalesce(F.trim("url"), F.lit("")) != "")).withColumn("text", text)
    key = F.concat(F.lit(f"{prefix}rel-"), F.substring(F.sha2(F.concat_ws("|", "text", "url"), 256), 1, 12))
    return rows.groupBy(key.alias("unit_id"), "text", "url").agg(F.array_sort(F.collect_set("unit")).alias("anchored_by"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def theme_strength(facets: DataFrame, least: float = 0.45) -> DataFrame:
    """(profile, facet, weight, v) with strength: own weight plus the weights of the
    profile's other facets times their cosine where that is ``least`` or more.
    Facets of one profile are a few dozen by nature; profiles never meet."""
    other = facets.select("profile", F.col("facet").alias("o"), F.col("weight").alias("w2"), F.col("v").alias("v2"))
    sim = dot(F.col("v"), F.col("v2"))
    near = facets.join(other, "profile").filter(F.col("facet") != F.col("o")).withColumn("sim", sim).filter(F.col("sim") >= least)
    more = near.groupBy("profile", "facet").agg(F.sum(F.col("w2") * F.col("sim")).alias("more"))
    return facets.join(more, ["profile", "facet"], "left").withColumn("strength", F.col("weight") + F.coalesce("more", F.lit(0.0))).drop("more")


def rank_facets(facets: DataFrame, targets: DataFrame, power: float = 0.5) -> DataFrame:
    """Facets (profile, facet, v, strength) for each category (code, t): by cosine
    times the strength's power, ties by facet."""
    scored = facets.crossJoin(F.broadcast(targets.limit(64))).withColumn("score", F.round(dot(F.col("v"), F.col("t")) * F.pow("strength", F.lit(power)), 6))
    order = Window.partitionBy("profile", "code").orderBy(F.desc("score"), "facet")
    return scored.withColumn("place", F.row_number().over(order).cast("long")).select("profile", "code", "facet", "score", "place")


def artefacts(lines: DataFrame, most: int = 6, least_words: int = 12, cap: int = 40, same: float = 0.8) -> DataFrame:
    """Each profile's most substantive lines (profile, line, words, weight, v):
    weight times words up to ``cap``, heaviest first, a line whose vector is close
    to one that stays left out.  What goes depends on what stays, so each profile's
    lines, a few dozen by nature, are scanned in order."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, vectors = [], []
        for row in pdf.sort_values(["score", "line"], ascending=[False, True]).itertuples():
            v = np.asarray(row.v, np.float64)
            if len(kept) < most and not any(float(v @ k) >= same for k in vectors):
                kept.append(row.line)
                vectors.append(v)
        return pd.DataFrame({"profile": pdf["profile"].iloc[0], "line": kept, "seat": range(1, len(kept) + 1)})

    scored = lines.filter(F.col("words") >= least_words).withColumn("score", F.col("weight") * F.least("words", F.lit(cap)))
    return scored.select("profile", "line", "score", "v").groupBy("profile").applyInPandas(pick, "profile long, line long, seat int")


def reserved_candidates(hits: DataFrame, already: DataFrame, window: int = 20) -> DataFrame:
    """Hits of gap queries (qid, unit, rank, band, nameable) that may compete for a
    reserved seat: by query, then by stretches of ``window`` ranks, inside one by
    band and rank; units chosen already, seen before or without a name left out."""
    first = hits.filter("nameable").join(already.select("unit").distinct(), "unit", "left_anti").groupBy("unit").agg(
        F.min(F.struct("qid", "rank", "band")).alias("f")).select("unit", "f.*")
    order = Window.partitionBy("qid").orderBy(F.floor((F.col("rank") - 1) / window), "band", "rank")
    return first.withColumn("place", F.row_number().over(order).cast("long"))


def uncovered_terms(terms: DataFrame, hits: DataFrame, texts: DataFrame) -> DataFrame:
    """Query terms (qid, term) that none of the query's hits (qid, unit) holds."""
    words = hits.join(texts, "unit").select("qid", F.explode(F.array_distinct(T.words(F.col("text"), 4))).alias("term"))
    return terms.join(words, ["qid", "term"], "left_anti")


def follow_redirects(links: DataFrame, most_rounds: int = 32) -> DataFrame:
    """(host, target) to (host, final): every round doubles the steps taken, so
    chains of any length end in its logarithm; a cycle is an error."""
    at = cut(links.select("host", F.col("target").alias("final")), "redirects")
    for _ in range(most_rounds):
        further = at.select(F.col("host").alias("final"), F.col("final").alias("next"))
        step = cut(at.join(further, "final", "left").select("host", F.coalesce("next", "final").alias("final"), (F.coalesce("next", "final") != F.col("final")).alias("moved")), "redirects")
        at = step.select("host", "final")
        if step.filter("moved").isEmpty():
            return at
    raise ValueError("redirects run in a circle")


def evidence_units(rows: DataFrame, key: str, raw: str) -> DataFrame:
    """Evidence in any of three shapes: a list of units, an object that wraps one
    under ``units``, or an object of units by id; what is none gives no row."""
    unit = "struct<id: string, text: string>"
    flat, wrapped, keyed = (F.from_json(raw, s) for s in (f"array<{unit}>", f"struct<units: array<{unit}>>", "map<string, struct<text: string>>"))
    by_key = F.transform(F.map_entries(keyed), lambda e: F.struct(e["key"].alias("id"), e["value"]["text"].alias("text")))
    first = F.substring(F.trim(F.col(raw)), 1, 1)
    units = F.when(first == "[", flat).when(wrapped["units"].isNotNull(), wrapped["units"]).when(first == "{", by_key)
    return rows.select(key, F.explode(units).alias("u")).select(key, "u.id", "u.text").filter(F.col("text").isNotNull())


# Month names of job dates, and words beside which a duration is one of work.
MONTHS = {m: i for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), 1)}
_MONTH = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
DATED = re.compile(rf"\b{_MONTH}\.?\s*((?:19|20)\d\d)\s*(?:[-‐-―−]|to)+\s*(?:{_MONTH}\.?\s*((?:19|20)\d\d)|(present|current|now))", re.I)
DURATION = re.compile(r"\b(\d+(?:\.\d+)?)\+?\s*(?:\+\s*)?years?\b", re.I)
WORK = re.compile(r"\b(experience|full[\s-]?time|professional|employed|employment|career|consultant|analyst|engineer|manager|associate|developer"
                  r"|specialist|director|officer|contractor|freelance)\b", re.I)


def months_of_experience(text: str, today: tuple[int, int]) -> int:
    """The longest run of work that a text shows, in months: a range of months, or a
    number of years near a word of work.  ``today`` is (year, month)."""
    best = 0
    for m in DATED.finditer(text):
        year, month = today if m[5] else (int(m[4]), MONTHS[m[3].lower()])
        best = max(best, (year - int(m[2])) * 12 + month - MONTHS[m[1].lower()])
    for m in DURATION.finditer(text):
        if WORK.search(text[max(0, m.start() - 160) : m.end() + 160]):
            best = max(best, int(float(m[1]) * 12))
    return best


def experience(text: Column, today: tuple[int, int]) -> Column:
    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: months_of_experience(t or "", today))

    return run(text)
