"""Chapters chosen from several queries' hits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chapters as C
from ..operators import gaps as G
from ..operators import selection as S
from ..sources.shared import cut
from ..sources.tables import spread, table
from . import retrieval

QUERIES_EACH = 4
RULES = C.Rules(size=12, floors={"de": 0.2, "fr": 1}, kinds={"en": 6})


def chapter_selection(spark, d):
    """Four items ask for each chapter; their keyword hits are fused, each query's
    best hit has a seat reserved, as have hits beyond its tenth place (as gaps)."""
    code = F.concat(F.lit("C"), F.floor(F.col("qid") / QUERIES_EACH).cast("string"))
    hits = cut(retrieval.bm25_topk(spark, d), "hits").withColumn("code", code).withColumn("part", 1 / (60 + F.col("rank")).cast("double"))
    fused = hits.groupBy("code", "unit").agg(
        F.round(F.max("part") + 0.2 * (F.sum("part") - F.max("part")), 9).alias("score"),
        F.min(F.when(F.col("rank") == 1, F.col("qid"))).alias("query_place"),
    )
    spare = S.reserved_candidates(hits.filter(F.col("rank") > 10).join(
        table(spark, d, "documents").select(F.col("doc_id").alias("unit"), F.lit(0).alias("band"), (F.length("text") % 4 != 0).alias("nameable")), "unit",
    ), hits.filter(F.col("rank") <= 2)).select((F.floor(F.col("qid") / QUERIES_EACH)).alias("c"), "unit", F.col("place").alias("gap_place"))
    gaps = spare.groupBy(F.concat(F.lit("C"), F.col("c").cast("string")).alias("code"), "unit").agg(F.min("gap_place").alias("gap_place"))
    years = T.latest_year(F.col("text"))
    units = spread(table(spark, d, "documents")).select(
        F.col("doc_id").alias("unit"), F.concat_ws("/", "source", (F.col("doc_id") % 50).cast("string")).alias("page"), T.first_word(F.col("text")).alias("entity"),
        F.col("source").alias("host"), F.col("lang").alias("kind"), T.dedupe_key(F.col("text")).alias("dup"), years.isNotNull().alias("boilerplate"))
    support = table(spark, d, "labels").groupBy(F.col("doc_id").alias("unit")).agg(F.max((F.col("quality") == 0)).alias("support"))
    rows = fused.join(gaps, ["code", "unit"], "left").join(units, "unit").join(support, "unit", "left").withColumn("support", F.coalesce("support", F.lit(False)))
    # A repeated id is one candidate: of its rows the smallest is taken.
    traits = ["page", "entity", "host", "kind", "dup", "boilerplate"]
    once = Window.partitionBy("code", "unit").orderBy(*traits)
    rows = rows.withColumn("rn", F.row_number().over(once)).filter("rn = 1").drop("rn")
    place = F.row_number().over(Window.partitionBy("code", "kind").orderBy(F.length("dup"), "unit"))
    rows = rows.withColumn("kind_place", F.when(F.col("kind") == "fr", place)).withColumn("fit", F.lit(None).cast("int")).withColumn("gap_score", F.lit(None).cast("double"))
    return C.choose_units(rows, RULES).filter(F.col("seat").isNotNull()).select("code", "unit", "seat", "phase")


def _entries(spark, d):
    """Items as entries of a profile: four to a chapter, the first one's words
    being what the first pass asks for."""
    q, facet = F.col("item_id"), F.col("item_id") % QUERIES_EACH
    code = F.concat(F.lit("C"), F.floor(q / QUERIES_EACH).cast("string"))
    return table(spark, d, "benchmark").select(code.alias("code"), q.alias("entry"), (facet > 1).alias("blind"), facet.alias("facet_rank"), "text")


def gap_queries(spark, d):
    """Entries whose rare words open documents but stand in none that was chosen."""
    entries, docs = _entries(spark, d), spread(table(spark, d, "documents"))
    asked = entries.filter(F.col("facet_rank") == 0)
    terms = retrieval.query_terms(spark, d)
    opening = docs.select(F.explode(F.array_distinct(F.slice(T.words(F.col("text"), 4), 1, 6))).alias("term"))
    fits = opening.join(terms.select("term").distinct(), "term").groupBy("term").agg(F.count(F.lit(1)).alias("fit"))
    hits = retrieval.bm25_topk(spark, d).filter((F.col("rank") <= 5) & (F.col("qid") % QUERIES_EACH == 0))
    read = hits.join(docs.select(F.col("doc_id").alias("unit"), "text"), "unit")
    covered = read.select(F.concat(F.lit("C"), F.floor(F.col("qid") / QUERIES_EACH).cast("string")).alias("code"), F.explode(F.array_distinct(T.words(F.col("text"), 4))).alias("term"))
    found = G.plan_gaps(entries, G.term_counts(docs, "text", terms), fits, covered, asked.select("code", F.col("entry").alias("query"), "text"), least_fit=2)
    return found.select("code", "place", "entry", "lead", "fit", "query")


QUERIES = {f.__name__: f for f in (chapter_selection, gap_queries)}
_WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]{{4,}}'))"
ORACLES = {
    "gap_queries": f"""WITH {retrieval._BM25},
e AS (SELECT 'C' || (item_id // 4) AS code, item_id AS entry, item_id % 4 AS facet_rank, {_WORDS.format("text")} AS ws FROM benchmark),
ew AS (SELECT code, entry, term, min(pos) AS pos FROM (SELECT code, entry, unnest(a) AS term, generate_subscripts(a, 1) AS pos
  FROM (SELECT code, entry, regexp_extract_all(lower(text), '[a-z0-9]{{4,}}') AS a FROM e JOIN (SELECT item_id AS entry, text FROM benchmark) USING (entry))) GROUP BY ALL),
dw AS (SELECT doc_id, unnest({_WORDS.format("text")}) AS term FROM documents),
counts AS (SELECT term, count(*) AS n_df FROM dw WHERE term IN (SELECT term FROM ew) GROUP BY term),
size AS (SELECT count(*) AS n_units FROM documents),
fits AS (SELECT term, count(*) AS fit FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{4,}}')[1:6])) AS term FROM documents) GROUP BY term),
covered AS (SELECT DISTINCT 'C' || (qid // 4) AS code, dw.term FROM words JOIN dw ON dw.doc_id = words.unit WHERE rank <= 5 AND qid % 4 = 0),
known AS (SELECT * FROM ew JOIN counts USING (term), size WHERE n_df >= 3),
lead AS (SELECT code, entry, fit, term AS lead FROM known JOIN fits USING (term) WHERE n_df <= greatest(25, floor(n_units * 0.006)) AND fit >= 2
  AND (code, term) NOT IN (SELECT (code, term) FROM covered) QUALIFY row_number() OVER (PARTITION BY code, entry ORDER BY fit DESC, term) = 1),
kept AS (SELECT * FROM known WHERE n_df <= greatest(25, floor(n_units * 0.006), floor(n_units * 0.05)) QUALIFY row_number() OVER (PARTITION BY code, entry ORDER BY n_df, term) <= 12),
qs AS (SELECT code, entry, list(term ORDER BY pos) AS ts FROM kept GROUP BY ALL),
fresh AS (SELECT qs.* FROM qs JOIN e f ON f.code = qs.code AND f.facet_rank = 0 WHERE len(list_intersect(ts, f.ws)) / len(ts) <= 0.6)
SELECT code, place, entry, lead, fit, query FROM (SELECT code, entry, lead, fit, array_to_string(ts, ' ') AS query,
  row_number() OVER (PARTITION BY code ORDER BY facet_rank > 1 DESC, fit DESC, facet_rank, entry) AS place FROM fresh JOIN lead USING (code, entry) JOIN e USING (code, entry)) WHERE place <= 2""",
}
