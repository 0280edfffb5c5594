"""Queries of selection, relations, readiness and small readers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import rules as R
from ..operators import selection as S
from ..sources.tables import table
from . import graph, retrieval
from .rules import noted


def relation_units(spark, d):
    """Chains of suppliers as units that can be cited."""
    names = F.create_map(*[F.lit(x) for x in ("SUPPLIES", "OFFERED_BY", "BUYS", "MEMBER_OF", "IN", "LOCATED_IN")])
    chains = graph.graph_expand_topk(spark, d).select("unit", names[F.col("predicate")].alias("predicate"), "direction", F.col("unit").alias("anchor"), "other",
                                                      F.lit("stated").alias("evidence"), F.concat(F.lit("https://x/"), "other").alias("url"))
    return S.relation_units(chains, "c-").select("unit_id", "text", F.array_join("anchored_by", ",").alias("anchored_by"))


def entity_types(spark, d):
    """The first type of each name, attached to units that carry the name."""
    first = graph.nodes_of(spark, d).groupBy("name_key").agg(F.min_by("type", "id").alias("type"))
    units = table(spark, d, "part").select(F.lower("p_name").alias("name_key"), "p_partkey")
    return units.join(first, "name_key", "left").groupBy("type").agg(F.count(F.lit(1)).alias("units"), F.countDistinct("name_key").alias("names"))


def fact_pages(spark, d):
    """Facts whose page is there, by source."""
    facts = table(spark, d, "labels").select("doc_id", "quality")
    return facts.join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("facts"), F.sum("quality").alias("good"))


def group_counts(spark, d):
    """Groups by type, and by each of their categories."""
    parts = table(spark, d, "part").select("p_brand", F.split("p_type", " ").alias("tags"))
    by_type = parts.groupBy(F.col("p_brand").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("type").alias("kind"), "value", "n")
    by_tag = parts.select(F.explode("tags").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n")).select(F.lit("category").alias("kind"), "value", "n")
    return by_type.unionByName(by_tag)


def readiness_divisions(spark, d):
    """Gates on the spread between divisions and on every division's floor."""
    docs = table(spark, d, "documents")
    each = docs.groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("facts"), F.countDistinct(T.first_word(F.col("text"))).alias("names"))
    m = each.agg(F.max("facts").alias("best"), F.min("facts").alias("worst"), F.count_if(F.col("facts") < 5).alias("under"), F.min("names").alias("names"))
    gate = lambda part, name, ok, detail: F.struct(F.lit(part).alias("part"), F.lit(name).alias("name"), ok.alias("ok"), detail.cast("double").alias("detail"))
    ratio = F.round(F.col("best") / F.greatest("worst", F.lit(1)), 6)
    return m.select(F.explode(F.array(gate("B", "spread", ratio <= 12, ratio), gate("B", "floor", F.col("under") == 0, F.col("under")), gate("C", "named", F.col("names") >= 5, F.col("names")))).alias("g")).select("g.*")


def snapshot_usage(spark, d):
    """Sums of each snapshot (hour), then their mean and maximum."""
    each = table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("at")).agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    return each.groupBy("event_type").agg(F.count(F.lit(1)).alias("snapshots"), F.round(F.avg("s"), 4).alias("mean"), F.round(F.max("s"), 4).alias("largest"), F.max("n").alias("most"))


def bucket_compare(spark, d):
    """Neighbouring turns as two fetches of one page: returned, similar, words kept."""
    line = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").withColumn("w", F.array_distinct(T.words(F.col("text"), 3))).withColumn("p", F.lag("w").over(line)).filter(F.col("p").isNotNull())
    return t.groupBy("role").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.size("w") > 0).alias("returned"), F.count_if(T.overlap(F.col("w"), F.col("p")) >= 0.8).alias("similar"),
        F.sum(F.size(F.array_intersect("w", "p"))).alias("kept"), F.sum(F.size("p")).alias("total"))


def category_counts(spark, d):
    """Statements that some wanted source has, and distinct openings, by category."""
    from .evidence import statement_lines

    merged = statement_lines(spark, d).withColumn("k", T.merge_key(F.col("statement"))).filter(F.col("k") != "").groupBy("lang", "k").agg(F.collect_set("source").alias("sources"))
    wanted = merged.filter(F.arrays_overlap("sources", F.array(F.lit("src0"), F.lit("src1"))))
    return wanted.groupBy("lang").agg(F.count(F.lit(1)).alias("facts"), F.countDistinct(F.split("k", " ")[0]).alias("entities"))


def _facets(spark, d):
    return table(spark, d, "embeddings").select(
        F.floor(F.col("vec_id") / 20).alias("profile"), F.col("vec_id").alias("facet"), ((F.col("vec_id") % 5 + 1) / 5.0).alias("weight"), F.col("embedding").alias("v"))


def theme_semantic(spark, d):
    return S.theme_strength(_facets(spark, d), 0.15).select("profile", "facet", F.round("strength", 6).alias("strength"))


def facet_ranking(spark, d):
    """Facets of every profile against two categories' lenses."""
    strong = S.theme_strength(_facets(spark, d), 0.15)
    targets = table(spark, d, "embeddings").filter(F.col("vec_id").isin(1, 2)).select(F.concat(F.lit("C"), F.col("vec_id").cast("string")).alias("code"), F.col("embedding").alias("t"))
    return S.rank_facets(strong.select("profile", "facet", "v", "strength"), targets)


def anchor_lines(spark, d):
    rows = _facets(spark, d).select("profile", F.col("facet").alias("line"), (F.col("facet") % 37 + 5).alias("words"), "weight", "v")
    return S.artefacts(rows, same=0.3)


def reserved_seats(spark, d):
    """Keyword hits that may take a gap's seat, dense hits being chosen already."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("unit"), (F.when(F.col("text").rlike("[0-9]"), 0).otherwise(1)).alias("band"), (F.length("text") % 4 != 0).alias("nameable"))
    hits = retrieval.bm25_topk(spark, d).join(docs, "unit")
    already = retrieval.dense_topk(spark, d).filter(F.col("rank") <= 2)
    return S.reserved_candidates(hits, already).select("qid", "unit", "band", "place")


def gap_terms(spark, d):
    """Terms of each item that none of its ten best passages holds."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("unit"), "text")
    hits = retrieval.bm25_topk(spark, d).filter(F.col("rank") <= 3).select("qid", "unit")
    return S.uncovered_terms(retrieval.query_terms(spark, d), hits, texts)


def final_hosts(spark, d):
    """Where redirects end: every host hands on to a third of its number."""
    k = F.col("s_suppkey")
    links = table(spark, d, "supplier").select(k.alias("host"), F.when(k >= 10, F.floor(k / 3)).otherwise(k).alias("target"))
    return S.follow_redirects(links)


def evidence_shapes(spark, d):
    """Evidence written in three shapes and none, read back."""
    unit = F.struct(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("text"))
    shape = F.when(F.col("doc_id") % 4 == 0, F.to_json(F.array(unit))).when(F.col("doc_id") % 4 == 1, F.to_json(F.struct(F.array(unit).alias("units"))))
    shape = shape.when(F.col("doc_id") % 4 == 2, F.to_json(F.create_map(F.col("doc_id").cast("string"), F.struct(F.col("source").alias("text"))))).otherwise("no json")
    return S.evidence_units(table(spark, d, "documents").select("doc_id", shape.alias("raw")), "doc_id", "raw")


def fact_scores(spark, d):
    """Additive scores of statements: group size, host, age, figures, sources."""
    docs = table(spark, d, "documents")
    sizes = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("group_size"))
    year = T.latest_year(F.col("text"))
    score = (
        F.least("group_size", F.lit(25)) * 0.4 + F.when(F.col("source") == "src0", 3).otherwise(0) - F.when(F.length("text") < 40, 6).otherwise(0)
        - F.when(year < 2018, 4).otherwise(0) + F.when(year >= 2024, 1.5).otherwise(0) + F.when(F.col("text").rlike("[0-9]"), 1).otherwise(0))
    return docs.join(sizes, "lang").select("doc_id", F.round(score.cast("double"), 4).alias("score"))


def distinctive_elements(spark, d):
    """The seven heaviest entries of each group, one for each opening of forty
    characters in lower case."""
    rows = table(spark, d, "part").select("p_brand", F.lower(F.substring("p_name", 1, 40)).alias("k"), "p_size", "p_partkey")
    first = Window.partitionBy("p_brand", "k").orderBy(F.desc("p_size"), "p_partkey")
    place = Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey")
    kept = rows.withColumn("rn", F.row_number().over(first)).filter("rn = 1")
    return kept.withColumn("place", F.row_number().over(place).cast("long")).filter(F.col("place") <= 7).select("p_brand", "p_partkey", "place")


def attempted_sets(spark, d):
    """What every engine tried: an intersection of three sets, partly ordered by priority."""
    tried = lambda p: table(spark, d, "orders").filter(F.col("o_orderpriority").startswith(p)).select("o_custkey")
    both = tried("1").join(tried("2").distinct(), "o_custkey", "left_semi").join(tried("3").distinct(), "o_custkey", "left_semi")
    return both.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


def grammar_or_graph(spark, d):
    """Names of people by their wording or because the graph has them."""
    nodes = graph.nodes_of(spark, d).filter(F.col("type") == "part").select(F.col("name_key").alias("k")).distinct().withColumn("known", F.lit(True))
    rows = noted(spark, d).select("doc_id", F.col("note").rlike(R.PERSON).alias("by_grammar"), F.when(F.col("doc_id") % 3 == 0, F.lit("almond azure")).otherwise(F.lower(F.substring_index("note", " ", 1))).alias("k"))
    return rows.join(nodes, "k", "left").select("doc_id", (F.col("by_grammar") | F.coalesce("known", F.lit(False))).alias("person"))


def two_hops(spark, d):
    """Paths of two edges: order to customer to nation, counted at their ends."""
    a = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("mid"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("mid"), F.col("c_nationkey").alias("end"))
    return a.join(b, "mid").groupBy("end").agg(F.count(F.lit(1)).alias("paths"), F.countDistinct("mid").alias("mids"))


def carriers(spark, d):
    """Items and summary lines through one check, then apart again."""
    docs = noted(spark, d)
    items = docs.select("doc_id", F.lit("item").alias("role"), F.col("note").alias("text"))
    summary = docs.select("doc_id", F.lit("summary").alias("role"), F.substring_index("body", "\n", 1).alias("text"))
    checked = items.unionByName(summary).withColumn("ok", ~R.non_factual(F.col("text")) & R.cut_reason(F.col("text")).isNull())
    return checked.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("ok"))


def pack_ids(spark, d):
    """Ids CODE-i in order of length: the hundred first of each category."""
    line = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    ranked = table(spark, d, "documents").select("lang", "doc_id", "n_chars").withColumn("i", F.row_number().over(line)).filter(F.col("i") <= 100)
    return ranked.select("doc_id", F.concat(F.upper("lang"), F.lit("-"), F.col("i").cast("string")).alias("pack_id"))


def first_names(spark, d):
    """The first capitalised word of a header's twelve lines."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.slice(F.split("text", "\n"), 1, 12)).alias("pos", "line"))
    hit = lines.withColumn("token", F.regexp_extract("line", "([A-Z][a-z]{2,})", 1)).filter(F.col("token") != "")
    return hit.groupBy("doc_id").agg(F.min_by("token", "pos").alias("name"))


def table_rows(spark, d):
    """Rows of a table written with bars, parsed back."""
    raw = table(spark, d, "part").select("p_partkey", F.concat(F.lit("| "), F.col("p_name"), F.lit(" | "), F.col("p_brand"), F.lit(" | "), F.col("p_size").cast("string"), F.lit(" |")).alias("line"))
    cell = lambda i: F.trim(F.get(F.split("line", r"\|"), F.lit(i)))
    return raw.select("p_partkey", cell(1).alias("name"), cell(2).alias("brand"), cell(3).cast("long").alias("size"))


def restriction_block(spark, d):
    """Restrictions of each category's units in the order they are first seen."""
    tags = noted(spark, d).select("lang", "doc_id", F.posexplode(R.restrictions(F.col("body"))).alias("i", "tag"))
    first = tags.groupBy("lang", "tag").agg(F.min(F.struct("doc_id", "i")).alias("at"))
    return first.groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "tag"))), lambda x: x["tag"]), ",").alias("block"))


def experience_months(spark, d):
    """Months of work that a text shows."""
    spans = F.element_at(F.array(*[F.lit(x) for x in ("Engineer, Jan 2019 - Mar 2021", "5 years of experience", "2016-2020 school", "Analyst May 2024 to present", "9 years old")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", S.experience(F.concat("text", F.lit("\n"), spans), (2026, 1)).alias("months"))


def reference_year(spark, d):
    """The year of the build if it is known, else the newest year of any unit."""
    built = table(spark, d, "orders").agg(F.year(F.max("o_orderdate")).alias("built"))
    newest = table(spark, d, "documents").agg(F.max(T.latest_year(F.col("text"))).alias("newest"))
    return built.crossJoin(F.broadcast(newest)).select(F.coalesce("built", "newest").cast("long").alias("year"))


def quota_numbers(spark, d):
    """Seats of the own kind, and fit scores from a map with a default."""
    fit = F.create_map(*[F.lit(x) for x in ("Brand#11", 3, "Brand#22", 2, "Brand#33", 1)])
    n = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.least(n, F.floor(F.lit(20) * 0.5)).cast("long").alias("own"), F.coalesce(fit[F.col("p_brand")], F.lit(0)).cast("long").alias("fit"))


def short_urls(spark, d):
    """Addresses without scheme, www and a closing slash, and cited ids of a text."""
    short = F.regexp_replace(F.regexp_replace("url", "^https?://(www[.])?", ""), "/+$", "")
    return table(spark, d, "pages").select("page_id", short.alias("short"))


QUERIES = {f.__name__: f for f in (
    relation_units, entity_types, fact_pages, group_counts, readiness_divisions, snapshot_usage, bucket_compare, category_counts, theme_semantic, facet_ranking,
    anchor_lines, reserved_seats, gap_terms, final_hosts, evidence_shapes, fact_scores, distinctive_elements, attempted_sets, grammar_or_graph, two_hops,
    carriers, pack_ids, first_names, table_rows, restriction_block, experience_months, reference_year, quota_numbers, short_urls)}

from .evidence import _ALNUM, _WORDS, _YEARS  # noqa: E402
from .graph import ORACLES as _GRAPH  # noqa: E402
from .retrieval import _BM25, _DENSE  # noqa: E402
from .rules import _NOTED, _TAGGED, _has  # noqa: E402

_PHRASE = "CASE predicate WHEN 'SUPPLIES' THEN 'is offered by' WHEN 'BUYS' THEN 'is a member of' ELSE 'is located in' END"
_FACETS = """f AS (SELECT vec_id // 20 AS profile, vec_id AS facet, (vec_id % 5 + 1) / 5.0::DOUBLE AS weight, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.profile, a.facet, b.weight AS w2, list_dot_product(a.v, b.v) AS sim FROM f a JOIN f b ON a.profile = b.profile AND a.facet <> b.facet),
more AS (SELECT profile, facet, sum(w2 * sim) AS more FROM p WHERE sim >= 0.15 GROUP BY ALL),
strong AS (SELECT f.*, weight + coalesce(more, 0) AS strength FROM f LEFT JOIN more USING (profile, facet))"""
_CUTS = f"""(CASE WHEN {_has('t', R.PROTECTED)} THEN NULL WHEN {_has('t', R.METADATA)} THEN 'm' WHEN {_has('t', R.EMPTY)} THEN 'e' END) IS NULL AND NOT (NOT regexp_matches(t, '[A-Za-z]')
  OR (len(list_filter(string_split_regex(trim(t), '\\s+'), lambda w: w <> '')) <= 4 AND NOT (regexp_matches(t, '[0-9]') OR regexp_matches(t, '["“”]') OR {_has('t', R.PROSPECT)} OR {_has('t', R.NAME)})))"""

ORACLES = {
    "relation_units": f"""WITH c AS ({_GRAPH['graph_expand_topk']}), t AS (SELECT unit, CASE WHEN direction = 'in' THEN other || ' ' || {_PHRASE} || ' ' || unit ELSE unit || ' ' || {_PHRASE} || ' ' || other END || '.' AS text, 'https://x/' || other AS url FROM c)
SELECT 'c-rel-' || substr(sha256(text || '|' || url), 1, 12) AS unit_id, text, array_to_string(list_sort(list(DISTINCT unit)), ',') AS anchored_by FROM t GROUP BY text, url""",
    "entity_types": """WITH n AS (SELECT 'customer:' || c_custkey AS id, 'customer' AS type, lower(c_name) AS k FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', lower(s_name) FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'part', lower(p_name) FROM part UNION ALL SELECT 'nation:' || n_nationkey, 'nation', lower(n_name) FROM nation), f AS (SELECT k, arg_min(type, id) AS type FROM n GROUP BY k)
SELECT type, count(*) AS units, count(DISTINCT k) AS names FROM (SELECT lower(p_name) AS k FROM part) LEFT JOIN f USING (k) GROUP BY type""",
    "fact_pages": "SELECT source, count(*) AS facts, CAST(sum(quality) AS BIGINT) AS good FROM labels JOIN documents USING (doc_id) GROUP BY source",
    "group_counts": """SELECT 'type' AS kind, p_brand AS value, count(*) AS n FROM part GROUP BY p_brand UNION ALL
SELECT 'category', v, count(*) FROM (SELECT unnest(string_split(p_type, ' ')) AS v FROM part) GROUP BY v""",
    "readiness_divisions": f"""WITH e AS (SELECT source, count(*) FILTER (lang = 'en') AS facts, count(DISTINCT ({_WORDS.format('text')})[1]) AS names FROM documents GROUP BY source),
m AS (SELECT round(max(facts) / greatest(min(facts), 1), 6) AS ratio, count(*) FILTER (facts < 5) AS under, min(names) AS names FROM e)
SELECT 'B' AS part, 'spread' AS name, ratio <= 12 AS ok, CAST(ratio AS DOUBLE) AS detail FROM m UNION ALL SELECT 'B', 'floor', under = 0, under FROM m UNION ALL SELECT 'C', 'named', names >= 5, names FROM m""",
    "snapshot_usage": """WITH e AS (SELECT event_type, date_trunc('hour', ts) AS at, sum(value) AS s, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, count(*) AS snapshots, round(avg(s), 4) AS mean, round(max(s), 4) AS largest, max(n) AS most FROM e GROUP BY event_type""",
    "bucket_compare": """WITH t AS (SELECT conv_id, turn, role, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS w FROM conversations),
p AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM t)
SELECT role, count(*) AS pages, count(*) FILTER (len(w) > 0) AS returned, count(*) FILTER (least(len(w), len(p)) > 0 AND len(list_intersect(w, p)) / least(len(w), len(p)) >= 0.8) AS similar,
  CAST(sum(len(list_intersect(w, p))) AS BIGINT) AS kept, CAST(sum(len(p)) AS BIGINT) AS total FROM p WHERE p IS NOT NULL GROUP BY role""",
    "category_counts": f"""WITH l AS (SELECT lang, source, unnest(string_split(text, chr(10))) AS s FROM documents), k AS (SELECT lang, source, {_ALNUM.format('s')} AS k FROM l),
m AS (SELECT lang, k FROM k WHERE k <> '' GROUP BY lang, k HAVING count(*) FILTER (source IN ('src0', 'src1')) > 0)
SELECT lang, count(*) AS facts, count(DISTINCT string_split(k, ' ')[1]) AS entities FROM m GROUP BY lang""",
    "theme_semantic": f"WITH {_FACETS} SELECT profile, facet, round(strength, 6) AS strength FROM strong",
    "facet_ranking": f"""WITH {_FACETS}, t AS (SELECT 'C' || vec_id AS code, CAST(embedding AS DOUBLE[]) AS t FROM embeddings WHERE vec_id IN (1, 2)),
s AS (SELECT profile, code, facet, round(list_dot_product(v, t) * pow(strength, 0.5), 6) AS score FROM strong, t)
SELECT *, row_number() OVER (PARTITION BY profile, code ORDER BY score DESC, facet) AS place FROM s""",
    "reserved_seats": f"""WITH {_BM25}, {_DENSE}, h AS (SELECT qid, unit, rank, CASE WHEN regexp_matches(text, '[0-9]') THEN 0 ELSE 1 END AS band FROM words JOIN documents ON doc_id = unit
  WHERE length(text) % 4 <> 0 AND unit NOT IN (SELECT unit FROM dense WHERE rank <= 2)), f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY unit ORDER BY qid, rank) = 1)
SELECT qid, unit, band, row_number() OVER (PARTITION BY qid ORDER BY (rank - 1) // 20, band, rank) AS place FROM f""",
    "gap_terms": f"""WITH {_BM25}, c AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{4,}}')) AS term FROM words JOIN documents ON doc_id = unit WHERE rank <= 3)
SELECT qid, term FROM terms EXCEPT SELECT qid, term FROM c""",
    "final_hosts": """WITH RECURSIVE l AS (SELECT s_suppkey AS host, CASE WHEN s_suppkey >= 10 THEN s_suppkey // 3 ELSE s_suppkey END AS t FROM supplier),
w AS (SELECT host, t AS final, 0 AS n FROM l UNION ALL SELECT w.host, l.t, n + 1 FROM w JOIN l ON l.host = w.final AND l.t <> w.final) SELECT host, arg_max(final, n) AS final FROM w GROUP BY host""",
    "evidence_shapes": "SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, source AS text FROM documents WHERE doc_id % 4 < 3",
    "fact_scores": f"""WITH g AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), y AS (SELECT *, {_YEARS.format('text')} AS year FROM documents JOIN g USING (lang))
SELECT doc_id, round((least(n, 25) * 0.4 + CASE WHEN source = 'src0' THEN 3 ELSE 0 END - CASE WHEN length(text) < 40 THEN 6 ELSE 0 END - CASE WHEN year < 2018 THEN 4 ELSE 0 END
  + CASE WHEN year >= 2024 THEN 1.5 ELSE 0 END + CASE WHEN regexp_matches(text, '[0-9]') THEN 1 ELSE 0 END)::DOUBLE, 4) AS score FROM y""",
    "distinctive_elements": """WITH k AS (SELECT *, lower(substr(p_name, 1, 40)) AS k FROM part), f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY p_brand, k ORDER BY p_size DESC, p_partkey) = 1)
SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS place FROM f QUALIFY place <= 7""",
    "attempted_sets": """SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority LIKE '1%' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '2%')
  AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '3%') GROUP BY o_custkey""",
    "grammar_or_graph": f"""WITH {_NOTED}, k AS (SELECT doc_id, {_has('note', R.PERSON)} AS g, CASE WHEN doc_id % 3 = 0 THEN 'almond azure' ELSE lower(string_split(note, ' ')[1]) END AS k FROM noted)
SELECT doc_id, g OR k IN (SELECT lower(p_name) FROM part) AS person FROM k""",
    "two_hops": 'SELECT c_nationkey AS "end", count(*) AS paths, count(DISTINCT c_custkey) AS mids FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1',
    "carriers": f"""WITH {_NOTED}, u AS (SELECT 'item' AS role, note AS t FROM noted UNION ALL SELECT 'summary', string_split(body, chr(10))[1] FROM noted)
SELECT role, count(*) AS n, count(*) FILTER ({_CUTS}) AS ok FROM u GROUP BY role""",
    "pack_ids": "SELECT doc_id, upper(lang) || '-' || i AS pack_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS i FROM documents) WHERE i <= 100",
    "first_names": """WITH l AS (SELECT doc_id, pos, l[pos] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, least(12, len(string_split(text, chr(10)))) + 1)) AS pos FROM documents)),
t AS (SELECT *, regexp_extract(line, '([A-Z][a-z]{2,})', 1) AS token FROM l) SELECT doc_id, arg_min(token, pos) AS name FROM t WHERE token <> '' GROUP BY doc_id""",
    "table_rows": "SELECT p_partkey, trim(p_name) AS name, p_brand AS brand, CAST(p_size AS BIGINT) AS size FROM part",
    "restriction_block": f"""WITH {_NOTED}, {_TAGGED}, x AS (SELECT lang, doc_id, i, tags[i] AS tag FROM (SELECT *, unnest(range(1, len(tags) + 1)) AS i FROM t)),
f AS (SELECT lang, tag, min(doc_id * 100 + i) AS place FROM x GROUP BY ALL) SELECT lang, string_agg(tag, ',' ORDER BY place) AS block FROM f GROUP BY lang""",
    "reference_year": "SELECT CAST(year(max(o_orderdate)) AS BIGINT) AS year FROM orders",
    "quota_numbers": "SELECT p_partkey, CAST(least(p_size, 10) AS BIGINT) AS own, CAST(CASE p_brand WHEN 'Brand#11' THEN 3 WHEN 'Brand#22' THEN 2 WHEN 'Brand#33' THEN 1 ELSE 0 END AS BIGINT) AS fit FROM part",
    "short_urls": "SELECT page_id, regexp_replace(regexp_replace(url, '^https?://(www[.])?', ''), '/+$', '') AS short FROM pages",
}
