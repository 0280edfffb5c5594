"""Queries over structured records and gap retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import claims as C
from ..operators import records as R
from ..sources.tables import table
from .retrieval import bm25_topk, dense_topk


def course_json(spark, d):
    """Orders written as nested JSON in markup, parsed back to sections."""
    lines = table(spark, d, "lineitem")
    section = F.struct(
        F.col("l_linenumber").cast("string").alias("id"), F.col("l_returnflag").alias("type"), F.array(F.col("l_quantity"), F.lit(4.0)).alias("units"),
        F.array(F.lit("Mon"), F.lit("Wed")).alias("days"), F.lit("09:00").alias("start"), F.lit("09:50").alias("end"), F.col("l_linenumber").alias("registered"),
        F.array(F.struct(F.lit("S").alias("first"), F.col("l_suppkey").cast("string").alias("last"))).alias("instructors"))
    bodies = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(section)).alias("sections")).select(
        F.concat(F.lit("<pre>"), F.to_json(F.struct(F.lit("ORD").alias("dept"), F.col("l_orderkey").cast("string").alias("number"), F.lit("t").alias("title"), "sections")), F.lit("</pre>")).alias("body"))
    s = R.parse_course_json(bodies, "body").select("code", F.explode("sections").alias("s"))
    return s.select("code", "s.id", "s.type", "s.units", "s.schedule", F.col("s.registered").cast("long").alias("registered"), F.array_join("s.instructors", ",").alias("instructors"))


def prerequisites(spark, d):
    parts = table(spark, d, "part").groupBy("p_size", "p_brand").agg(F.array_sort(F.collect_set(F.col("p_partkey").cast("string"))).alias("g"))
    groups = parts.groupBy("p_size").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_brand", "g"))), lambda x: x["g"]).alias("groups"))
    return groups.select("p_size", F.md5(R.prerequisite_text(F.col("groups"))).alias("text_md5"))


def entity_resolution(spark, d):
    aliases = spark.createDataFrame([("Brand#1", 1, "almond|azure", "warm"), ("Brand#1", 2, "a", "any"), ("Brand#2", 1, "^p", "p-words")], "alias_type string, rule_no int, pattern string, canonical string")
    parts = table(spark, d, "part").select("p_partkey", F.concat(F.lit("The "), F.col("p_name")).alias("name"), F.substring("p_brand", 1, 7).alias("kind"))
    return R.resolve_entities(parts, "name", "kind", aliases).select("p_partkey", "entity")


def name_matching(spark, d):
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("person"), F.translate("c_name", "0123456789", "abcdefghij").alias("name"))
    pages = table(spark, d, "customer").filter(F.col("c_custkey") % 2 == 0).select(
        F.concat(F.lit("u/"), F.col("c_custkey").cast("string")).alias("url"), F.translate("c_name", "0123456789", "abcdefghij").alias("title"), (F.col("c_custkey") % 3).alias("rank"))
    return R.match_names(people, pages).groupBy("how").agg(F.count(F.lit(1)).alias("n"), F.sum("person").alias("sum_person"))


def kind_quota(spark, d):
    kinds = table(spark, d, "embeddings").select(F.col("vec_id").alias("unit"), F.concat(F.lit("k"), (F.col("label") % 3).cast("string")).alias("kind"))
    hits = dense_topk(spark, d).select("qid", "unit", "score").join(kinds, "unit")
    return R.kind_quota(hits, {"k1": 4, "k2": 6}, 15).select("qid", "unit", "kind", "score", F.col("rank").cast("long").alias("rank"))


def bm25_floor(spark, d):
    return R.score_floor(bm25_topk(spark, d)).groupBy("qid").agg(F.count(F.lit(1)).alias("n"))


def gap_seats(spark, d):
    return table(spark, d, "part").select("p_size").distinct().select("p_size", R.gap_slots(F.col("p_size")).cast("long").alias("slots"))


QUOTED = '"([^"\\n]+)"'


def masked_quotes(spark, d):
    """Every span in double quotes blanked out wherever it stands."""
    docs = table(spark, d, "documents").withColumn("spans", F.regexp_extract_all("text", F.lit(QUOTED), F.lit(1))).filter(F.size("spans") > 0)
    return docs.select("doc_id", F.size("spans").cast("long").alias("n"), F.md5(R.mask_spans(F.col("text"), F.col("spans"))).alias("masked_md5"))


def phone_redaction(spark, d):
    docs = table(spark, d, "documents").select("doc_id", R.redact_phones(F.col("text")).alias("t"), "text")
    return docs.filter(F.col("t") != F.col("text")).select("doc_id", F.length("t").cast("long").alias("n"))


def rephrase_filter(spark, d):
    """Query terms not already covered by more than 60% in the first pass."""
    t = table(spark, d, "conversations").select("conv_id", "turn", "role", F.explode(F.array_distinct(T.words(F.col("text"), 4))).alias("w"))
    seen = t.filter(F.col("role") == "assistant").select("conv_id", "w", F.lit(1).alias("seen")).distinct()
    share = F.count("seen") / F.count(F.lit(1))
    return t.filter(F.col("role") == "user").join(seen, ["conv_id", "w"], "left").groupBy("conv_id", "turn").agg(F.round(share, 6).alias("share"), (share > 0.6).alias("rephrase"))


def fact_order(spark, d):
    """Statements (lines) by number of sources, then core hosts, then text: the
    ten first of each language."""
    from pyspark.sql import Window

    from .evidence import statement_lines

    lines = statement_lines(spark, d).withColumn("k", T.merge_key(F.col("statement"))).filter(F.col("k") != "")
    g = lines.groupBy("lang", "k").agg(F.countDistinct("source").alias("n_sources"), F.max((F.col("source") == "src0").cast("int")).alias("core"))
    order = Window.partitionBy("lang").orderBy(F.desc("n_sources"), F.desc("core"), "k")
    return g.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= 10).select("lang", "k", "n_sources", "place")


def useful_gate(spark, d):
    """Turns of which seven tenths or more restate others, or under ninety
    characters without a name, go; counted by role."""
    s = C.sentence_rows(table(spark, d, "conversations"), ["conv_id", "turn", "role"], "text")
    items = s.groupBy("conv_id", "turn", "role").agg(
        F.avg(F.col("restates").cast("int")).alias("cut"), F.sum(F.when(~F.col("restates"), F.length("sentence")).otherwise(0)).alias("left"),
        F.max(F.col("sentence").rlike("[a-z] [A-Z][a-z]+ [A-Z][a-z]+").cast("int")).alias("names"))
    kept = (F.col("cut") < 0.7) & ((F.col("left") >= 90) | (F.col("names") == 1))
    return items.groupBy("role").agg(F.count(F.lit(1)).alias("items"), F.count_if(kept).alias("kept"))


def directory_parse(spark, d):
    """Documents written as directory pages of a source, five hundred ids each,
    parsed back to blocks."""
    entry = F.concat(F.lit("## [doc "), F.col("doc_id").cast("string"), F.lit("](https://x/"), F.col("doc_id").cast("string"), F.lit(")\nby "), F.col("lang"), F.lit("\n")).alias("e")
    leaf = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 500).cast("string"))
    pages = table(spark, d, "documents").groupBy(leaf.alias("leaf")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", entry))), lambda x: x["e"]), "").alias("page"))
    return R.directory_blocks(pages, "leaf", "page").select("leaf", F.col("pos").cast("long").alias("pos"), "name", "link", "body", "next_name")


QUERIES = {f.__name__: f for f in (
    course_json, prerequisites, entity_resolution, name_matching, kind_quota, bm25_floor, gap_seats, masked_quotes, phone_redaction,
    rephrase_filter, fact_order, useful_gate, directory_parse)}

from .evidence import _ALNUM  # noqa: E402
from .retrieval import _BM25, _DENSE  # noqa: E402  the SQL of the lists that these queries start from

ORACLES = {
    "course_json": """SELECT 'ORD ' || l_orderkey AS code, CAST(l_linenumber AS VARCHAR) AS id, l_returnflag AS type,
  CASE WHEN l_quantity = 4 THEN '4' ELSE CAST(least(l_quantity, 4) AS BIGINT) || '-' || CAST(greatest(l_quantity, 4) AS BIGINT) END AS units,
  'Mon/Wed 09:00-09:50' AS schedule, CAST(l_linenumber AS BIGINT) AS registered, 'S ' || l_suppkey AS instructors FROM lineitem""",
    "prerequisites": """WITH g AS (SELECT p_size, p_brand, array_to_string(list_sort(list(DISTINCT CAST(p_partkey AS VARCHAR))), ' or ') AS t FROM part GROUP BY ALL)
SELECT p_size, md5(string_agg(t, '; ' ORDER BY p_brand)) AS text_md5 FROM g GROUP BY p_size""",
    "entity_resolution": """SELECT p_partkey, CASE WHEN k = 'Brand#1' AND regexp_matches(n, 'almond|azure') THEN 'warm' WHEN k = 'Brand#1' AND regexp_matches(n, 'a') THEN 'any'
  WHEN k = 'Brand#2' AND regexp_matches(n, '^p') THEN 'p-words' ELSE n END AS entity FROM (SELECT p_partkey, trim(lower(p_name)) AS n, substr(p_brand, 1, 7) AS k FROM part)""",
    "name_matching": """WITH n AS (SELECT c_custkey, regexp_extract_all(lower(translate(c_name, '0123456789', 'abcdefghij')), '[a-z]+') AS t FROM customer),
p AS (SELECT c_custkey AS person, t[1] AS f, t[-1] AS l FROM n), g AS (SELECT 'u/' || c_custkey AS url, t[1] AS f, t[-1] AS l FROM n WHERE c_custkey % 2 = 0),
b AS (SELECT person, 'full' AS how FROM p WHERE EXISTS (SELECT 1 FROM g WHERE g.f = p.f AND g.l = p.l)
  UNION ALL SELECT person, 'last' FROM p WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.f = p.f AND g.l = p.l) AND (SELECT count(*) FROM g WHERE g.l = p.l) = 1)
SELECT how, count(*) AS n, CAST(sum(person) AS BIGINT) AS sum_person FROM b GROUP BY how""",
    "kind_quota": f"""WITH {_DENSE}, h AS (SELECT qid, unit, 'k' || (label % 3) AS kind, score FROM dense JOIN embeddings ON vec_id = unit),
f AS (SELECT *, row_number() OVER (PARTITION BY qid, kind ORDER BY score DESC, unit) <= CASE kind WHEN 'k1' THEN 4 WHEN 'k2' THEN 6 ELSE 0 END AS held FROM h),
c AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY qid ORDER BY held DESC, score DESC, unit) <= 15)
SELECT qid, unit, kind, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit) AS rank FROM c""",
    "bm25_floor": f"WITH {_BM25} SELECT qid, count(*) AS n FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS best FROM words) WHERE score >= 0.5 * best GROUP BY qid",
    "gap_seats": "SELECT DISTINCT p_size, CAST(CASE WHEN p_size <= 2 THEN 0 ELSE greatest(1, least(4, round_even(p_size / 6, 0))) END AS BIGINT) AS slots FROM part",
    "masked_quotes": """WITH s AS (SELECT doc_id, text, regexp_extract_all(text, '"([^"\\n]+)"', 1) AS spans FROM documents)
SELECT doc_id, len(spans) AS n, md5(list_reduce(list_prepend(text, spans), lambda t, x: replace(t, x, ' '))) AS masked_md5 FROM s WHERE len(spans) > 0""",
    "rephrase_filter": """WITH t AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) AS w FROM conversations), u AS (SELECT * FROM t WHERE len(w) > 0),
f AS (SELECT conv_id, list_distinct(flatten(list(w))) AS seen FROM u WHERE role = 'assistant' GROUP BY conv_id)
SELECT conv_id, turn, round(len(list_intersect(w, coalesce(seen, []))) / len(w), 6) AS share, len(list_intersect(w, coalesce(seen, []))) / len(w) > 0.6 AS rephrase FROM u LEFT JOIN f USING (conv_id) WHERE role = 'user'""",
    "fact_order": f"""WITH l AS (SELECT lang, source, unnest(string_split(text, chr(10))) AS s FROM documents),
g AS (SELECT lang, k, count(DISTINCT source) AS n_sources, max(CAST(source = 'src0' AS INT)) AS core FROM (SELECT *, {_ALNUM.format('s')} AS k FROM l) WHERE k <> '' GROUP BY lang, k)
SELECT lang, k, n_sources, place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_sources DESC, core DESC, k) AS place FROM g) WHERE place <= 10""",
    "directory_parse": """SELECT leaf, row_number() OVER w AS pos, 'doc ' || doc_id AS name, 'https://x/' || doc_id AS link, 'by ' || lang AS body, lead('doc ' || doc_id) OVER w AS next_name
  FROM (SELECT *, source || '/' || (doc_id // 500) AS leaf FROM documents) WINDOW w AS (PARTITION BY leaf ORDER BY doc_id)""",
}
