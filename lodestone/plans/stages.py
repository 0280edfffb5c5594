"""Stages around a model, with a stand-in that answers by rule."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import stages as S
from ..sources.tables import table

SCHEMA = "struct<n: int, words: int>"


def stand_in(prompts: list[str], turn: int) -> list[str]:
    """Answers by rule: prompts of a multiple of seven bytes fail in the first
    turn, of 35 always; a batch that holds one with 13 loses a response."""
    answers = []
    for p in prompts:
        n = len(p.encode())
        broken = n % 35 == 0 or (n % 7 == 0 and turn == 1)
        answers.append("{broken" if broken else json.dumps({"n": n, "words": len(p.split(" "))}))
    return answers[:-1] if len(prompts) > 1 and any(len(p.encode()) % 13 == 0 for p in prompts) else answers


def model_retries(spark, d):
    """Every document judged by the stand-in, those of src0 being done already."""
    docs = table(spark, d, "documents").filter(F.col("text").isNotNull())
    done = docs.filter(F.col("source") == "src0").select("doc_id")
    out = S.model_stage(docs, "doc_id", "text", stand_in, SCHEMA, F.col("answer.n").isNotNull() & (F.col("answer.words") > 0), done=done)
    return out.select("doc_id", F.col("answer.n").cast("long").alias("n"), F.col("answer.words").cast("long").alias("words"), F.col("turn").cast("long").alias("turn"))


def profile_items(spark, d):
    """Items whose evidence stands in their document, outside its last line."""
    text, at = F.col("text"), F.col("doc_id") % 11 + 1
    evidence = F.when(F.col("doc_id") % 5 == 0, F.concat(F.substring(text, 1, 20), F.lit("x"))).when(F.col("doc_id") % 3 == 0, F.element_at(F.split(text, "\n"), -1)).otherwise(
        F.substr(text, at, F.col("doc_id") % 17 + 3))
    docs = table(spark, d, "documents").select("doc_id", "text", evidence.alias("evidence"), F.element_at(F.split(text, "\n"), -1).alias("bad"))
    return docs.select("doc_id", S.item_fate(F.col("evidence"), F.col("text"), F.col("bad")).alias("fate"))


def blind_assignment(spark, d):
    return S.blind_batches(table(spark, d, "pages"), "page_id", 4, 10, "20260916").select("page_id", F.col("version").cast("long").alias("version"), "batch", "label")


def extraction_packs(spark, d):
    """Chunks of 600 characters for extraction, with no limit on their number."""
    docs = table(spark, d, "documents").select("doc_id", "text")

    def run(batches):
        for pdf in batches:
            rows = [(k, i, len(c)) for k, t in zip(pdf["doc_id"], pdf["text"]) for i, c in enumerate(S.extraction_chunks(t or "", 600, None))]
            yield pd.DataFrame(rows, columns=["doc_id", "pos", "n"])

    return docs.mapInPandas(run, "doc_id long, pos long, n long")


def news_results(spark, d):
    """Search results of trusted hosts off the root, each page at its first sight;
    a position of zero counts as missing."""
    rows = table(spark, d, "pages").select("page_id", U.page_key(F.col("url")).alias("key"), U.bare_host(F.col("url")).alias("host"), (F.col("page_id") % 10).alias("position"))
    kept = rows.filter(F.col("host").rlike("[.](com|net)$") & ~U.under(F.col("host"), "example.com"))
    priority = 60 - F.coalesce(F.nullif(F.col("position"), F.lit(0)), F.lit(5))
    first = kept.withColumn("priority", priority.cast("long")).groupBy("key").agg(F.min_by(F.struct("page_id", "priority"), "page_id").alias("f"))
    return first.select("key", "f.page_id", "f.priority")


QUERIES = {f.__name__: f for f in (model_retries, profile_items, blind_assignment, extraction_packs, news_results)}

from .evidence import _ALNUM  # noqa: E402
from .web import _BARE, _PATH, _QUERY  # noqa: E402

_KEY = f"lower({_BARE.format('url')} || regexp_replace({_PATH.format('url')}, '/+$', '') || CASE WHEN {_QUERY.format('url')} <> '' THEN '?' || {_QUERY.format('url')} ELSE '' END)"
ORACLES = {
    "model_retries": """WITH t AS (SELECT doc_id, strlen(text) AS n, len(string_split(text, ' ')) AS words FROM documents WHERE source <> 'src0' AND text IS NOT NULL)
SELECT doc_id, CASE WHEN n % 35 <> 0 THEN n END AS n, CASE WHEN n % 35 <> 0 THEN words END AS words, CASE WHEN n % 35 = 0 THEN 3 WHEN n % 7 = 0 THEN 2 ELSE 1 END::BIGINT AS turn FROM t""",
    "profile_items": f"""WITH t AS (SELECT doc_id, text, string_split(text, chr(10))[-1] AS bad FROM documents),
e AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN substr(text, 1, 20) || 'x' WHEN doc_id % 3 = 0 THEN bad ELSE substr(text, doc_id % 11 + 1, doc_id % 17 + 3) END AS evidence FROM t),
f AS (SELECT doc_id, {_ALNUM.format("coalesce(evidence, '')")} AS needle, {_ALNUM.format("coalesce(text, '')")} AS hay, {_ALNUM.format("coalesce(bad, '')")} AS q FROM e)
SELECT doc_id, CASE WHEN length(needle) < 8 AND NOT (needle <> '' AND contains(' ' || hay || ' ', ' ' || needle || ' ')) THEN 'short' WHEN NOT contains(hay, needle) THEN 'absent'
  WHEN q <> '' AND (contains(q, needle) OR contains(needle, q)) THEN 'quarantined' END AS fate FROM f""",
    "blind_assignment": """WITH p AS (SELECT page_id, row_number() OVER (ORDER BY substr(md5(page_id || '|20260916'), 1, 15)) - 1 AS i FROM (SELECT DISTINCT page_id FROM pages))
SELECT page_id, v AS version, (i * 4 + v) % 10 AS batch, substr(md5(page_id || '|' || v || '|20260916|label'), 1, 12) AS label FROM p, range(4) r(v)""",
    "news_results": f"""WITH r AS (SELECT page_id, {_KEY} AS key, {_BARE.format('url')} AS host FROM pages),
k AS (SELECT * FROM r WHERE regexp_matches(host, '[.](com|net)$') AND NOT (host = 'example.com' OR ends_with(host, '.example.com')))
SELECT key, page_id, 60 - CASE page_id % 10 WHEN 0 THEN 5 ELSE page_id % 10 END AS priority FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY page_id) = 1""",
}
