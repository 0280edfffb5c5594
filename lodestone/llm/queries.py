"""Queries of the corpus operators, one ``opN_<name>`` each, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread
from . import ann, decontam, langid, licenses, line_dedup, mixing, near_dedup, secrets, substring_dedup, toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "is_kept")


def op3_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(_read(spark, sf_dir, "embeddings"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs)).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends to the ledger that the session names, so that a later run scans new
    blobs only; a session that names none starts with an empty one."""
    return secrets.scan_secrets(_read(spark, sf_dir, "documents"), spark.conf.get(LEDGER_SETTING, None))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.drop_repeated_passages(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_repeated_lines(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


LEDGER_SETTING = "spark.lodestone.secretLedger"

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_near_dedup": op2_near_dedup,
    "op3_nearest_vectors": op3_nearest_vectors,
    "op4_mix_sources": op4_mix_sources,
    "op5_language_id": op5_language_id,
    "op6_secret_scan": op6_secret_scan,
    "op7_decontaminate": op7_decontaminate,
    "op8_license_scan": op8_license_scan,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_line_dedup": op10_line_dedup,
}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_SPLIT_SPANS = """
  SELECT doc_id, {ord} AS ord, '{kind}' AS kind, unnest(range(1, len(m) + 1)) AS i, m, p
  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p FROM d)
"""


def _secrets_sql() -> str:
    parts = [_SPLIT_SPANS.format(ord=i, kind=kind, pattern=pattern.replace("'", "''")) for i, (kind, pattern, *_) in enumerate(secrets.RULES)]
    value = secrets.ASSIGN.replace("'", "''")
    least = " ".join(f"WHEN '{kind}' THEN {n}" for kind, _, n, *_ in secrets.RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({" UNION ALL ".join(parts)}),
spans AS (
  SELECT doc_id, ord, kind, m[i] AS hit,
    list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS s
  FROM raw),
kept AS (
  SELECT doc_id, ord, kind, CAST(s AS BIGINT) AS s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + length(hit) AS BIGINT) AS span
  FROM spans
  WHERE CASE WHEN kind = 'assign' THEN length(regexp_extract(hit, '{value}', 2)) ELSE length(hit) END >= CASE kind {least} END)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY s, ord) FILTER (kind IN ('assign', 'access', 'hex')), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY s, ord), '') AS spans
FROM d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id
"""


def _licenses_sql() -> str:
    phrases, templates = [], []
    for phrase, label in licenses.PHRASES:
        words = phrase.split()
        test = " AND ".join(f"w[i + {j + 1}] = '{x}'" for j, x in enumerate(words))
        phrases.append(f"SELECT doc_id, '{label}' AS label, i FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - {len(words) - 1}, 0))) AS i FROM d) WHERE {test}")
    for no, label, words, need, width in licenses.plan_of(licenses.TEMPLATES, 0.85):
        templates.append(f"SELECT {no} AS no, '{label}' AS label, {words!r} AS t, {need} AS need, {width} AS width")
    return f"""
WITH d AS (SELECT doc_id, text, {WORDS} AS w FROM documents),
places AS ({" UNION ALL ".join(phrases)}),
base AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS z, list(DISTINCT label) AS labels FROM places GROUP BY doc_id),
templates AS ({" UNION ALL ".join(templates)}),
able AS (SELECT doc_id, w, label, t, need, least(width, len(w)) AS width FROM d, templates WHERE len(list_intersect(w, t)) >= need),
blocks AS (SELECT doc_id, label, t, need, w[i + 1:i + width] AS w FROM (SELECT *, unnest(range(0, len(w) - width + 1)) AS i FROM able)),
hits AS (SELECT doc_id, label, len(list_intersect(w, t)) AS shared, len(t) AS n, need FROM blocks),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(shared / n) AS best FROM hits WHERE shared >= need GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base, base.a AS first_word, base.z AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
  CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""


ORACLES = {
    "op6_secret_scan": _secrets_sql(),
    "op7_decontaminate": f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
wins AS (SELECT DISTINCT item, array_to_string(w[i + 1:i + 8], ' ') AS win, least(8, len(w)) AS n
  FROM (SELECT item, w, unnest(range(0, greatest(len(w) - 7, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
grams AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS win
  FROM (SELECT doc_id, n, w, unnest(range(0, greatest(len(w) - n + 1, 0))) AS i FROM d, sizes)),
hits AS (SELECT doc_id, item, i, n FROM grams JOIN wins USING (win, n)),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op8_license_scan": _licenses_sql(),
    "op9_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 49, 0))) AS i FROM d)),
firsts AS (SELECT k, min(doc_id) AS a FROM wins GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM wins JOIN firsts USING (k) WHERE doc_id > a),
words AS (SELECT doc_id, unnest(range(0, len(w))) AS pos, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) AS BIGINT) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
    "op10_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (SELECT *, {LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k FROM lines),
bad AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (bad.k IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (bad.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN bad USING (k) GROUP BY doc_id
""",
}
