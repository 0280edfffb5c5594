"""Structured records: parsers of crawled text, nested JSON, names and aliases."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COURSE = (
    "dept string, number string, title string, sections array<struct<id: string, type: string, units: array<double>, "
    "days: array<string>, start: string, end: string, registered: int, instructors: array<struct<first: string, last: string>>>>"
)


def parse_course_json(bodies: DataFrame, body: str) -> DataFrame:
    """Nested course JSON to typed sections.  A body that is wrapped in markup is
    cut to its outermost object; what is no object gives no row."""
    raw = F.regexp_extract(F.regexp_replace(body, "<[^>]*>", ""), "(?s)(\\{.*\\})", 1)
    c = F.from_json(raw, COURSE)
    rows = bodies.withColumn("c", F.when(raw != "", c)).filter(F.col("c.dept").isNotNull())
    sections = F.transform("c.sections", lambda s: F.struct(
        s["id"].alias("id"), s["type"].alias("type"), units_text(s["units"]).alias("units"),
        schedule_text(s["days"], s["start"], s["end"]).alias("schedule"), s["registered"].alias("registered"),
        F.array_sort(F.transform(s["instructors"], lambda p: F.concat_ws(" ", p["first"], p["last"]))).alias("instructors"),
    ))
    return rows.select(F.concat_ws(" ", "c.dept", "c.number").alias("code"), F.col("c.title").alias("title"), sections.alias("sections"))


def number_text(x: Column) -> Column:
    """Whole numbers without a decimal point, others as they are."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def units_text(units: Column) -> Column:
    """One number, or the smallest and largest joined by a hyphen."""
    low, high = F.array_min(units), F.array_max(units)
    return F.when(F.coalesce(F.size(units), F.lit(0)) <= 0, "").when(low == high, number_text(low)).otherwise(F.concat_ws("-", number_text(low), number_text(high)))


def schedule_text(days: Column, start: Column, end: Column) -> Column:
    return F.trim(F.concat_ws(" ", F.array_join(days, "/"), F.when(start.isNotNull() & end.isNotNull(), F.concat_ws("-", start, end))))


def prerequisite_text(groups: Column) -> Column:
    """Groups of alternatives as ``A or B; C``, empty groups left out."""
    return F.array_join(F.filter(F.transform(groups, lambda g: F.array_join(g, " or ")), lambda x: x != ""), "; ")


def directory_blocks(pages: DataFrame, key: str, text: str) -> DataFrame:
    """``## [name](link)`` blocks of a directory page: pos, name, link, body and
    the name of the block after it."""
    marked = F.regexp_replace(text, "(?m)^## \\[", "\u0001[")
    parts = pages.select(key, F.posexplode(F.split(marked, "\u0001")).alias("pos", "block")).filter(F.col("pos") > 0)
    name = F.regexp_extract("block", "^\\[([^\\]]*)\\]\\(([^)]*)\\)", 1)
    link = F.regexp_extract("block", "^\\[([^\\]]*)\\]\\(([^)]*)\\)", 2)
    line = Window.partitionBy(key).orderBy("pos")
    body = F.regexp_replace(F.regexp_replace("block", "^\\[[^\\]]*\\]\\([^)]*\\)", ""), "^\\s+|\\s+$", "")
    return parts.select(key, "pos", name.alias("name"), link.alias("link"), body.alias("body")).withColumn("next_name", F.lead("name").over(line))


def headings_to_hashes(text: str) -> str:
    """Underlined headings (a line, then === or ---) as # and ## headings."""
    lines, out = text.split("\n"), []
    for line in lines:
        if out and out[-1].strip() and not out[-1].startswith("#") and re.fullmatch(r"\s*(=+|-{3,})\s*", line):
            out[-1] = ("# " if "=" in line else "## ") + out[-1].strip()
        else:
            out.append(line)
    return "\n".join(out)


HEADER = re.compile(r"^([A-Z]{2,6})[ -](\d{2,4}[A-Z]?)\s*[:–-]\s*(.+)$")
SECTION = re.compile(r"^(\d{4,6}[A-Z]?)\s+(Lecture|Lab|Discussion|Seminar|Quiz)\b\s*(.*)$")


def schedule_lines(text: str) -> list[dict]:
    """A line grammar: a course header opens a record, a units line and text
    describe it, section lines belong to it until the next header."""
    found: list[dict] = []
    for line in (x.strip().lstrip("#").strip() for x in text.split("\n")):
        head, section = HEADER.match(line), SECTION.match(line)
        if head:
            found.append({"code": f"{head[1]} {head[2]}", "title": head[3].strip(), "units": "", "description": "", "sections": []})
        elif not found or not line:
            continue
        elif section:
            found[-1]["sections"].append({"id": section[1], "type": section[2], "rest": section[3].strip()})
        elif units := re.fullmatch(r"\(?(\d+(?:\.\d+)?(?:-\d+(?:\.\d+)?)?) units?\)?", line, re.I):
            found[-1]["units"] = units[1]
        elif not found[-1]["sections"]:
            found[-1]["description"] = f"{found[-1]['description']} {line}".strip()
    return found


def parse_schedules(pages: DataFrame, key: str, text: str) -> DataFrame:
    """Course records of schedule pages; the state runs along each page."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = [(k, c["code"], c["title"], c["units"], c["description"], c["sections"]) for k, t in zip(pdf[key], pdf[text]) for c in schedule_lines(headings_to_hashes(t or ""))]
            yield pd.DataFrame(rows, columns=[key, "code", "title", "units", "description", "sections"])

    return pages.select(key, text).mapInPandas(run, f"{key} {kind}, code string, title string, units string, description string, sections array<struct<id: string, type: string, rest: string>>")


def resolve_entities(rows: DataFrame, name: str, kind: str, aliases: DataFrame) -> DataFrame:
    """Canonical entity of each (name, type): a leading article dropped, then the
    first alias rule of the type that matches, else the folded name."""
    folded = F.trim(F.regexp_replace(F.lower(F.col(name)), "^(the|a|an) ", ""))
    keyed = rows.withColumn("entity_key", folded)
    ruled = keyed.join(F.broadcast(aliases), (keyed[kind] == aliases["alias_type"]) & F.expr("entity_key rlike pattern"), "left")
    return ruled.groupBy(*keyed.columns).agg(F.min_by("canonical", "rule_no").alias("canonical")).withColumn("entity", F.coalesce("canonical", "entity_key")).drop("canonical", "entity_key")


def name_keys(name: Column) -> tuple[Column, Column]:
    """First and last word of a name in plain ASCII letters."""
    plain = F.translate(F.lower(name), "áàâäãåçéèêëíìîïñóòôöõúùûüýß", "aaaaaaceeeeiiiinooooouuuuys")
    tokens = F.filter(F.split(F.regexp_replace(plain, "[^a-z]+", " "), " "), lambda x: x != "")
    return F.element_at(tokens, 1), F.element_at(tokens, -1)


def match_names(people: DataFrame, pages: DataFrame) -> DataFrame:
    """The best page of each person by (first, last) word, else by last word
    alone where only one page has it: (person, name) and (url, title, rank)."""
    first, last = name_keys(F.col("name"))
    p = people.withColumn("f", first).withColumn("l", last)
    tf, tl = name_keys(F.col("title"))
    t = pages.withColumn("f", tf).withColumn("l", tl)
    best = Window.partitionBy("person").orderBy("rank", F.length("url"), "url")
    full = p.join(t.drop("title"), ["f", "l"]).withColumn("rn", F.row_number().over(best)).filter("rn = 1").select("person", "url", F.lit("full").alias("how"))
    lone = t.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("url")).filter("n = 1").select("l", "url")
    rest = p.join(full.select("person"), "person", "left_anti").join(lone, "l").select("person", "url", F.lit("last").alias("how"))
    return full.unionByName(rest)


def redact_phones(text: Column) -> Column:
    """Ten-digit phone numbers in common spellings; longer digit runs stay."""
    return F.regexp_replace(text, "(?<![0-9])(\\+?1[ .-]?)?(\\([0-9]{3}\\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])", "[phone]")


def mask_spans(text: Column, spans: Column) -> Column:
    """Each span in turn blanked out."""
    return F.aggregate(spans, text, lambda t, s: F.replace(t, s, F.lit(" ")))


def gap_slots(n: Column) -> Column:
    """Seats for the gap pass: none up to two, else a sixth, rounded half to
    even, from one to four."""
    return F.when(n <= 2, 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(4), F.bround(n / 6, 0).cast("int"))))


def kind_quota(hits: DataFrame, floors: dict[str, int], k: int) -> DataFrame:
    """``k`` hits of each query with at least the given number of each kind."""
    wanted = F.create_map(*[x for name, n in floors.items() for x in (F.lit(name), F.lit(n))])
    within = Window.partitionBy("qid", "kind").orderBy(F.desc("score"), "unit")
    held = hits.withColumn("held", (F.row_number().over(within) <= F.coalesce(wanted[F.col("kind")], F.lit(0))).cast("int"))
    seats = Window.partitionBy("qid").orderBy(F.desc("held"), F.desc("score"), "unit")
    chosen = held.withColumn("seat", F.row_number().over(seats)).filter(F.col("seat") <= k)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "unit")
    return chosen.select("qid", "unit", "kind", "score", F.row_number().over(order).alias("rank"))


def score_floor(hits: DataFrame, share: float = 0.5) -> DataFrame:
    """Hits of at least ``share`` of their query's best score."""
    best = hits.withColumn("best", F.max("score").over(Window.partitionBy("qid")))
    return best.filter(F.col("score") >= share * F.col("best")).drop("best")
