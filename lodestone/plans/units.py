"""Queries that build units, plan queries and check responses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import units as U
from ..sources.tables import table
from .graph import nodes_of


def _units(spark, d):
    url = lambda kind, key: F.concat(F.lit(f"https://x/{kind}/"), F.col(key).cast("string"))
    facts = U.as_units(table(spark, d, "benchmark"), "fact", "c", F.col("text"), None, url("fact", "item_id"), [F.col("item_id")], code=F.lit("GEN"))
    chunks = U.as_units(table(spark, d, "documents"), "chunk", "c", F.col("text"), F.col("source"), url("chunk", "doc_id"), [F.col("doc_id"), F.col("lang")])
    orgs = U.as_units(table(spark, d, "supplier"), "org", "c", F.concat(F.lit("balance "), F.col("s_acctbal").cast("int").cast("string")), F.col("s_name"), url("org", "s_suppkey"), [F.col("s_suppkey")])
    courses = U.as_units(table(spark, d, "part"), "course", "c", F.col("p_name"), F.col("p_brand"), url("course", "p_partkey"), [F.col("p_partkey")], [F.col("p_type")])
    return facts.unionByName(chunks).unionByName(orgs).unionByName(courses)


def unit_union(spark, d):
    return _units(spark, d).select("kind", "unit_id", "category_code", F.sha1("embed_text").alias("embed_sha"), F.sha1("keyword_text").alias("keyword_sha"), "source_url", "year")


def index_check(spark, d):
    """Counts and vector norms that an index must agree on."""
    v = table(spark, d, "embeddings")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    units = _units(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("unit_id").alias("n_ids"))
    norms = v.agg(F.count(F.lit(1)).alias("n_vectors"), F.round(F.min(norm), 4).alias("least_norm"), F.round(F.max(norm), 4).alias("largest_norm"))
    return units.crossJoin(F.broadcast(norms))


def years_in_digits(spark, d):
    value = F.concat(F.lit("x"), F.col("o_orderkey").cast("string"), F.lit(" "), F.col("o_orderdate").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", U.first_year(value, 1990, 2030).alias("year"))


def query_terms_planned(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(U.query_tokens(F.col("text")), " ").alias("terms"))


def planned_queries(spark, d):
    items = table(spark, d, "conversations").select(
        F.col("conv_id").alias("profile"), F.col("role").alias("code"), F.col("turn").alias("ord"), "text", F.lit(1.0).alias("weight"))
    return U.plan_queries(items, 2).select("profile", "code", "qid", "text")


def graph_term_fit(spark, d):
    nodes = nodes_of(spark, d)
    terms = nodes.filter(F.col("type") == "part").select(F.explode(F.split("name_key", "[^a-z0-9]+")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter("n >= 10").select("term")
    return U.graph_fit(terms, nodes)


def response_validation(spark, d):
    """Documents' rows written as model responses; every third cites an unknown
    id, every fifth has no text, every seventh is broken."""
    docs = table(spark, d, "documents")
    ids = F.array(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, F.lit("none")).otherwise(F.lit("1")))
    item = F.struct(F.when(F.col("doc_id") % 5 == 0, F.lit(" ")).otherwise(F.lit("t")).alias("text"), ids.alias("ids"))
    raw = F.when(F.col("doc_id") % 7 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.array_repeat(item, (F.col("doc_id") % 4).cast("int")).alias("items"))))
    allowed = docs.select(F.col("doc_id").cast("string").alias("id"))
    return U.validate_json(docs.select(F.col("doc_id").alias("key"), raw.alias("raw")), "raw", "struct<text: string, ids: array<string>>", allowed, 1, 3)


def pending_calls(spark, d):
    calls = table(spark, d, "conversations").select("conv_id", "turn", F.lit("m").alias("model"), "text")
    cache = calls.filter(F.col("conv_id") % 3 == 0).withColumn("call_key", F.sha2(F.concat_ws("\u001f", "model", "text"), 256))
    return U.pending_calls(calls, cache, "model", "text").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


def bullet_support(spark, d):
    """Orders as bullets that state their lines' quantities and cite the lines."""
    lines = table(spark, d, "lineitem").withColumn("fact", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    bullets = lines.groupBy("l_orderkey").agg(F.concat_ws(" and ", F.sort_array(F.collect_list((F.col("l_quantity").cast("int") + F.when(F.col("l_linenumber") == 4, 100).otherwise(0)).cast("string")))).alias("text"))
    cites = lines.select(F.col("l_orderkey").alias("bullet"), "fact")
    facts = lines.select("fact", F.concat(F.lit("took "), F.col("l_quantity").cast("int").cast("string")).alias("fact_text"))
    return U.support(bullets.withColumnRenamed("l_orderkey", "bullet"), cites, facts)


def joint_cap_digest(spark, d):
    orders = table(spark, d, "orders").withColumn("clerk", F.col("o_custkey") % 40)
    return U.joint_caps(orders, "o_orderpriority", "o_totalprice", "o_orderkey", {"clerk": 8, "o_orderstatus": 90}, 120)


def anchor_seats(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label")
    rows = v.select((F.col("vec_id") % 4).alias("student"), (F.col("vec_id") % 7).alias("artefact"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("chapter"), F.col("vec_id").alias("unit"), (F.col("vec_id") % 60).alias("entity"))
    return U.seats_by_round(rows.withColumn("place", F.row_number().over(Window.partitionBy("student", "artefact").orderBy("unit"))), 4, 10)


def stale_statements(spark, d):
    """Passages whose newest year is before 2010, by language."""
    from ..functions import text as T

    docs = table(spark, d, "documents").withColumn("y", T.latest_year(F.col("text")))
    return docs.filter(F.col("y") < 2010).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.max("y").alias("newest"))


def unextracted_pages(spark, d):
    """Pages without an extracted statement whose first line is followed by another."""
    docs, have = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id").distinct()
    lines = docs.join(have, "doc_id", "left_anti").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    paired = lines.withColumn("next_line", F.lead("line").over(Window.partitionBy("doc_id").orderBy("pos"))).filter((F.col("pos") == 0) & F.col("next_line").isNotNull())
    return paired.select("doc_id", F.md5(F.concat_ws("|", "line", "next_line")).alias("fact_md5"))


def search_jobs(spark, d):
    """Sites by terms, both few by configuration; addresses at their first job."""
    sites = table(spark, d, "region").select(F.lower("r_name").alias("site"), "r_regionkey")
    terms = table(spark, d, "nation").select(F.lower("n_name").alias("term"), "n_nationkey")
    jobs = sites.crossJoin(F.broadcast(terms)).withColumn("job", F.col("r_regionkey") * 100 + F.col("n_nationkey"))
    links = jobs.select("job", "site", F.explode(F.sequence(F.lit(0), F.col("n_nationkey") % 4)).alias("rank"))
    first = Window.partitionBy("site", "rank").orderBy("job")
    return links.withColumn("rn", F.row_number().over(first)).filter("rn = 1").select("site", F.col("rank").cast("long").alias("rank"), F.col("job").cast("long").alias("job"), F.round(10 - F.col("rank") * F.lit(0.1).cast("double"), 6).alias("score"))


QUERIES = {f.__name__: f for f in (
    unit_union, index_check, years_in_digits, query_terms_planned, planned_queries, graph_term_fit, response_validation, pending_calls,
    bullet_support, joint_cap_digest, anchor_seats, stale_statements, unextracted_pages, search_jobs)}

_YEAR = "list_max(list_transform(regexp_extract_all({}, '(19[5-9][0-9]|20[0-3][0-9])'), lambda y: CAST(y AS INTEGER)))"
_UNIT = """SELECT '{k}' AS kind, 'c-{k}-' || substr(sha1(concat_ws('|', {key})), 1, 12) AS unit_id, {code} AS category_code, sha1({embed}) AS embed_sha, sha1({kw}) AS keyword_sha,
  'https://x/{k}/' || {id} AS source_url, {year} AS year FROM {t}"""
_UNITS = " UNION ALL ".join((
    _UNIT.format(k="fact", key="CAST(item_id AS VARCHAR)", code="'GEN'", embed="text", kw="text", id="item_id", year=_YEAR.format("text"), t="benchmark"),
    _UNIT.format(k="chunk", key="CAST(doc_id AS VARCHAR), lang", code="NULL", embed="source || ': ' || text", kw="text || ' ' || source", id="doc_id", year=_YEAR.format("text"), t="documents"),
    _UNIT.format(k="org", key="CAST(s_suppkey AS VARCHAR)", code="NULL", embed="s_name || ': balance ' || CAST(trunc(s_acctbal) AS INT)", kw="'balance ' || CAST(trunc(s_acctbal) AS INT) || ' ' || s_name", id="s_suppkey", year=_YEAR.format("'balance ' || CAST(trunc(s_acctbal) AS INT)"), t="supplier"),
    _UNIT.format(k="course", key="CAST(p_partkey AS VARCHAR)", code="NULL", embed="p_brand || ': ' || p_name", kw="p_name || ' ' || p_brand || ' ' || p_type", id="p_partkey", year=_YEAR.format("p_name"), t="part"),
))
_STOP = ", ".join(f"'{w}'" for w in U.STOP)
ORACLES = {
    "unit_union": _UNITS,
    "index_check": f"""WITH u AS ({_UNITS}), n AS (SELECT count(*) AS n_vectors, round(min(s), 4) AS least_norm, round(max(s), 4) AS largest_norm FROM (SELECT sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS s FROM embeddings))
SELECT kind, count(*) AS n, count(DISTINCT unit_id) AS n_ids, any_value(n_vectors) AS n_vectors, any_value(least_norm) AS least_norm, any_value(largest_norm) AS largest_norm FROM u, n GROUP BY kind""",
    "years_in_digits": """WITH v AS (SELECT o_orderkey, regexp_replace('x' || o_orderkey || ' ' || CAST(o_orderdate AS VARCHAR), '[^0-9]', ' ', 'g') AS t FROM orders)
SELECT o_orderkey, list_filter(list_transform(list_filter(list_transform(range(1, length(t) - 2), lambda i: substr(t, i, 4)), lambda w: regexp_full_match(w, '[0-9]{4}')), lambda w: CAST(w AS INT)), lambda y: y BETWEEN 1990 AND 2030)[1] AS year FROM v""",
    "query_terms_planned": f"""WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '([a-z]{{2,5}}[ -]?[0-9]{{3}}[a-z]?)', 1)) AS c, regexp_extract_all(lower(text), '[a-z0-9]{{3,}}') AS w FROM conversations),
c AS (SELECT conv_id, turn, x, min(i) AS i, 0 AS g FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '([a-z]{{2,5}}[ -]?[0-9]{{3}}[a-z]?)', 1)) AS x, generate_subscripts(regexp_extract_all(lower(text), '([a-z]{{2,5}}[ -]?[0-9]{{3}}[a-z]?)', 1), 1) AS i FROM conversations) GROUP BY ALL),
q AS (SELECT conv_id, turn, x, min(i) AS i, 1 AS g FROM (SELECT conv_id, turn, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w) WHERE x NOT IN ({_STOP}) GROUP BY conv_id, turn, x),
p AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) <= 24),
a AS (SELECT conv_id, turn, string_agg(x, ' ' ORDER BY g, i) AS terms FROM (FROM c UNION ALL FROM p) GROUP BY ALL)
SELECT conv_id, turn, coalesce(terms, '') AS terms FROM w LEFT JOIN a USING (conv_id, turn)""",
    "planned_queries": """WITH i AS (SELECT conv_id AS profile, role AS code, turn, text FROM conversations),
f AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY profile, code, lower(text) ORDER BY turn) = 1)
SELECT profile, code, row_number() OVER (PARTITION BY profile, code ORDER BY turn) AS qid, text FROM f QUALIFY qid <= 2""",
    "graph_term_fit": """WITH n AS (SELECT 'customer:' || c_custkey AS id, 'customer' AS type, lower(c_name) AS k FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', lower(s_name) FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'part', lower(p_name) FROM part UNION ALL SELECT 'nation:' || n_nationkey, 'nation', lower(n_name) FROM nation),
t AS (SELECT term FROM (SELECT unnest(string_split_regex(k, '[^a-z0-9]+')) AS term FROM n WHERE type = 'part') GROUP BY term HAVING count(*) >= 10),
w AS (SELECT DISTINCT id, type, unnest(string_split_regex(k, '[^a-z0-9]+')) AS term FROM n)
SELECT term, type, count(*) AS fit FROM w JOIN t USING (term) GROUP BY ALL""",
    "response_validation": """WITH d AS (SELECT doc_id AS key, doc_id % 7 = 0 AS bad, doc_id % 4 AS n FROM documents)
SELECT key, CASE WHEN bad THEN 'unparsed' ELSE array_to_string(list_sort(list_filter([CASE WHEN n = 0 THEN 'count' END, CASE WHEN n > 0 AND key % 5 = 0 THEN 'empty_text' END, CASE WHEN n > 0 AND key % 3 = 0 THEN 'unknown:none' END], lambda x: x IS NOT NULL)), ',') END AS errors FROM d""",
    "pending_calls": """SELECT conv_id, count(*) AS n FROM conversations WHERE text NOT IN (SELECT text FROM conversations WHERE conv_id % 3 = 0) GROUP BY conv_id""",
    "bullet_support": """WITH l AS (SELECT l_orderkey, CAST(l_quantity AS INT) AS q, CAST(l_quantity AS INT) + CASE WHEN l_linenumber = 4 THEN 100 ELSE 0 END AS c FROM lineitem),
m AS (SELECT DISTINCT l_orderkey, CAST(c AS VARCHAR) AS c FROM l WHERE NOT EXISTS (SELECT 1 FROM l x WHERE x.l_orderkey = l.l_orderkey AND x.q = l.c))
SELECT b.l_orderkey AS bullet, coalesce(string_agg(c, ',' ORDER BY c), '') AS lacking FROM (SELECT DISTINCT l_orderkey FROM l) b LEFT JOIN m USING (l_orderkey) GROUP BY 1""",
    "stale_statements": f"SELECT lang, count(*) AS n, max(y) AS newest FROM (SELECT lang, {_YEAR.format('text')} AS y FROM documents) WHERE y < 2010 GROUP BY lang",
    "unextracted_pages": """SELECT doc_id, md5(l[1] || '|' || l[2]) AS fact_md5 FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) WHERE len(l) >= 2""",
    "search_jobs": """WITH j AS (SELECT lower(r_name) AS site, r_regionkey * 100 + n_nationkey AS job, unnest(range(0, n_nationkey % 4 + 1)) AS rank FROM region, nation)
SELECT site, rank, CAST(min(job) AS BIGINT) AS job, round(10 - rank * 0.1::DOUBLE, 6) AS score FROM j GROUP BY site, rank""",
}
