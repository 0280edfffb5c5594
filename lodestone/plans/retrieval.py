"""Hybrid retrieval over documents (keyword half) and embeddings (dense half)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ranking as R
from ..operators import windows as W
from ..sources.tables import spread, table

K_WORDS, K_DENSE = 40, 40


def query_terms(spark, d):
    """Every benchmark item as a query: its distinct words of four letters or more."""
    items = table(spark, d, "benchmark")
    return items.select(F.col("item_id").alias("qid"), F.explode(F.array_distinct(T.words(F.col("text"), 4))).alias("term"))


def bm25_topk(spark, d):
    terms = query_terms(spark, d)
    index = R.postings(spread(table(spark, d, "documents")), "doc_id", {"text": 1.0, "source": 1.5}, terms, F.length("text") >= 40)
    return R.bm25(index, terms, K_WORDS).select("qid", "unit", "score", F.col("rank").cast("long").alias("rank"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("unit"), F.col("embedding").alias("v"), "label")


def _queries_dense(spark, d):
    """The stated query set: every vector whose id is divisible by fifty."""
    return table(spark, d, "embeddings").filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"), "label")


def dense_topk(spark, d):
    return R.dense(_vectors(spark, d), _queries_dense(spark, d), K_DENSE).select("qid", "unit", "score", F.col("rank").cast("long").alias("rank"))


def _lists(spark, d):
    weight = F.when(F.col("qid") == 0, 1.0).otherwise(0.85)
    words = bm25_topk(spark, d).select("qid", F.lit("words").alias("half"), "unit", "rank", weight.alias("weight"))
    dense = dense_topk(spark, d).select("qid", F.lit("dense").alias("half"), "unit", "rank", weight.alias("weight"))
    return words.unionByName(dense)


def damped_rrf(spark, d):
    return R.damped_fusion(_lists(spark, d))


def _boosted(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    fused = damped_rrf(spark, d)
    joined = fused.join(docs.select(F.col("doc_id").alias("unit"), "lang", "source", "text"), "unit").join(labels.withColumnRenamed("doc_id", "unit"), "unit", "left")
    kind = F.when(F.col("lang") == "en", 1.0).when(F.col("lang") == "de", 0.92).otherwise(0.9)
    fit = 1 + 0.1 * F.coalesce("quality", F.lit(0))
    return joined.withColumn("boosted", F.round(F.col("score") * kind * fit * T.recency(T.latest_year(F.col("text")), 2026), 14))


def rescore_boosts(spark, d):
    return _boosted(spark, d).select("unit", "score", "boosted")


def own_code_quota(spark, d):
    """Dense lists with at least ten rows of the query's own label."""
    main = dense_topk(spark, d).select("qid", "unit", "score")
    own = R.dense(_vectors(spark, d), _queries_dense(spark, d), K_DENSE, own=True).select("qid", "unit", "score")
    return R.own_quota(main, own, K_DENSE, 10).select("qid", "unit", "score", F.col("own").cast("long").alias("own"), F.col("rank").cast("long").alias("rank"))


def interleave_reserved(spark, d):
    out = R.interleave(dense_topk(spark, d).withColumn("query_ord", F.col("qid")), 5)
    return out.select("unit", F.col("seat").cast("long").alias("seat"), "rank", "query_ord")


def hybrid_retrieval(spark, d):
    """Flagship: both halves, damped fusion, boosts, the 24 best with at most two
    of a source."""
    best = W.cap_per_key(_boosted(spark, d), "source", [F.desc("boosted"), F.col("unit")], 2)
    return best.orderBy(F.desc("boosted"), "unit").limit(24).select("unit", "source", "lang", "score", "boosted")


QUERIES = {f.__name__: f for f in (bm25_topk, dense_topk, damped_rrf, rescore_boosts, own_code_quota, interleave_reserved, hybrid_retrieval)}

_BM25 = f"""
tok AS (SELECT doc_id AS unit, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term, 1.0 AS w FROM documents
  UNION ALL SELECT doc_id, unnest(regexp_extract_all(lower(source), '[a-z0-9]+')), 1.5 FROM documents),
len AS (SELECT unit, count(*) AS length FROM tok GROUP BY unit),
mean AS (SELECT avg(length) AS mean_length, count(*) AS n FROM len),
terms AS (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{4,}}')) AS term FROM benchmark),
tf AS (SELECT unit, term, sum(w) AS f FROM tok WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
ws AS (SELECT qid, unit, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean_length))), 6)::DOUBLE AS score
  FROM tf JOIN terms USING (term) JOIN df USING (term) JOIN len USING (unit), mean WHERE unit IN (SELECT doc_id FROM documents WHERE length(text) >= 40) GROUP BY qid, unit),
words AS (SELECT qid, unit, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit) AS rank FROM ws QUALIFY rank <= {K_WORDS})"""
_DENSE = f"""
q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS q, label AS own_label FROM embeddings WHERE vec_id % 50 = 0),
ds AS (SELECT qid, vec_id AS unit, round(list_dot_product(CAST(embedding AS DOUBLE[]), q), 6) AS score, label = own_label AS own FROM embeddings, q WHERE vec_id <> qid),
dense AS (SELECT qid, unit, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit) AS rank FROM ds QUALIFY rank <= {K_DENSE})"""
_FUSED = f"""{_BM25}, {_DENSE},
parts AS (SELECT unit, CASE WHEN qid = 0 THEN 1.0 ELSE 0.85 END::DOUBLE / (60 + rank) AS part FROM (SELECT qid, unit, rank FROM words UNION ALL SELECT qid, unit, rank FROM dense)),
fused AS (SELECT unit, round(max(part) + 0.2 * (sum(part) - max(part)), 9) AS score, count(*) AS n_lists FROM parts GROUP BY unit)"""
_BOOSTED = rf"""{_FUSED},
qual AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
years AS (SELECT doc_id, list_max(list_transform(regexp_extract_all(text, '{T.YEAR}'), lambda y: CAST(y AS INTEGER))) AS y FROM documents),
boosted AS (SELECT unit, source, lang, score, round(score * CASE lang WHEN 'en' THEN 1.0 WHEN 'de' THEN 0.92 ELSE 0.9 END::DOUBLE * (1 + 0.1::DOUBLE * coalesce(quality, 0))
  * CASE WHEN y IS NULL OR 2026 - y < -1 THEN 0.9 WHEN 2026 - y <= 0 THEN 1.0 ELSE greatest(0.55, pow(0.5, (2026 - y) / 5.0)) END::DOUBLE, 14) AS boosted
  FROM fused JOIN documents d ON d.doc_id = unit JOIN years USING (doc_id) LEFT JOIN qual USING (doc_id))"""

ORACLES = {
    "bm25_topk": f"WITH {_BM25} SELECT * FROM words",
    "dense_topk": f"WITH {_DENSE} SELECT * FROM dense",
    "damped_rrf": f"WITH {_FUSED} SELECT * FROM fused",
    "rescore_boosts": f"WITH {_BOOSTED} SELECT unit, score, boosted FROM boosted",
    "own_code_quota": f"""WITH {_DENSE}, mine AS (SELECT qid, unit, score FROM ds WHERE own QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit) <= {K_DENSE}),
b AS (SELECT qid, unit, max(score) AS score, max(own) AS own FROM (SELECT qid, unit, score, 0 AS own FROM dense UNION ALL SELECT qid, unit, score, 1 FROM mine) GROUP BY ALL),
h AS (SELECT *, own = 1 AND row_number() OVER (PARTITION BY qid, own ORDER BY score DESC, unit) <= 10 AS held FROM b),
c AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY qid ORDER BY held DESC, score DESC, unit) <= {K_DENSE})
SELECT qid, unit, score, CAST(own AS BIGINT) AS own, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit) AS rank FROM c""",
    "interleave_reserved": f"""WITH {_DENSE}, f AS (SELECT unit, rank, qid AS query_ord FROM dense WHERE rank <= 5 QUALIFY row_number() OVER (PARTITION BY unit ORDER BY rank, qid) = 1)
SELECT unit, row_number() OVER (ORDER BY rank, query_ord) AS seat, rank, query_ord FROM f""",
    "hybrid_retrieval": f"""WITH {_BOOSTED} SELECT unit, source, lang, score, boosted FROM (SELECT * FROM boosted QUALIFY row_number() OVER (PARTITION BY source ORDER BY boosted DESC, unit) <= 2)
ORDER BY boosted DESC, unit LIMIT 24""",
}
