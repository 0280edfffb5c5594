"""Queries over the foreign-key web as an entity graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources.files import expand_sitemaps
from ..sources.shared import cut
from ..sources.tables import table


def nodes_of(spark, d):
    part = lambda name, kind, key, label: table(spark, d, name).select(
        F.concat(F.lit(kind + ":"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("type"), F.lower(label).alias("name_key"))
    return (
        part("customer", "customer", "c_custkey", "c_name").unionAll(part("supplier", "supplier", "s_suppkey", "s_name"))
        .unionAll(part("part", "part", "p_partkey", "p_name")).unionAll(part("nation", "nation", "n_nationkey", "n_name"))
    )


def edges_of(spark, d):
    """Edges of all foreign keys; each order line gives two in one scan."""
    at = lambda kind, key: F.concat(F.lit(kind + ":"), F.col(key).cast("string")).alias
    edge = lambda a, name, b, pos: F.struct(a("src"), F.lit(name).alias("predicate"), b("dst"), pos.alias("pos"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    bought = lines.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    pos = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    both = bought.select(F.explode(F.array(edge(at("supplier", "l_suppkey"), "SUPPLIES", at("part", "l_partkey"), pos), edge(at("customer", "o_custkey"), "BUYS", at("part", "l_partkey"), pos))).alias("e"))
    both = both.select("e.*").filter(F.col("src").isNotNull())
    lives = table(spark, d, "customer").select(edge(at("customer", "c_custkey"), "IN", at("nation", "c_nationkey"), F.col("c_custkey")).alias("e")).select("e.*")
    based = table(spark, d, "supplier").select(edge(at("supplier", "s_suppkey"), "IN", at("nation", "s_nationkey"), F.col("s_suppkey")).alias("e")).select("e.*")
    return both.unionByName(lives).unionByName(based)


def graph_nodes(spark, d):
    """Nodes with counts of their statements and distinct sources."""
    lines = table(spark, d, "lineitem")
    return lines.groupBy(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("id")).agg(
        F.count(F.lit(1)).alias("fact_count"), F.countDistinct("l_suppkey").alias("source_count"),
        F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("categories"))


def graph_edges_dedup(spark, d):
    return G.dedupe_edges(G.resolve_edges(edges_of(spark, d), nodes_of(spark, d))).select("src", "predicate", "dst", "pos")


def graph_degree(spark, d):
    return G.degrees(nodes_of(spark, d), graph_edges_dedup(spark, d)).select("id", "type", "degree")


def graph_hub_threshold(spark, d):
    return G.hub_threshold(graph_degree(spark, d))


def graph_reorient(spark, d):
    """Every seventh edge is written the wrong way round, then repaired."""
    rules = spark.createDataFrame([("SUPPLIES", "supplier", "part"), ("BUYS", "customer", "part"), ("IN", "customer", "nation")], "predicate string, actor string, object string")
    kind = lambda c: F.split(c, ":")[0]
    wrong = F.col("pos") % 7 == 0
    mixed = graph_edges_dedup(spark, d).select(
        F.when(wrong, F.col("dst")).otherwise(F.col("src")).alias("src"), "predicate", F.when(wrong, F.col("src")).otherwise(F.col("dst")).alias("dst"))
    typed = mixed.withColumn("src_type", kind("src")).withColumn("dst_type", kind("dst"))
    return G.reorient(typed, rules).groupBy("predicate", "action").agg(F.count(F.lit(1)).alias("n"))


def graph_expand_topk(spark, d):
    """One-hop chains of suppliers that are no hubs.  Edges and degrees are written
    once; the threshold, the calm nodes and the chains read them."""
    edges = cut(graph_edges_dedup(spark, d).select("src", "predicate", "dst"), "edges")
    degree = cut(G.degrees(nodes_of(spark, d).select("id", "type"), edges), "degrees")
    threshold = G.hub_threshold(degree, times=1, floor=40)
    anchors = degree.filter(F.col("type") == "supplier").select(F.col("id").alias("unit"), F.col("id").alias("node"))
    out = G.expand(anchors, edges, degree, threshold)
    return out.select("unit", F.col("rank").cast("long").alias("rank"), "predicate", "direction", "other", "degree")


def home_institutions(spark, d):
    """Nations by degree: the three largest are home, others foreign."""
    from pyspark.sql import Window

    nations = graph_degree(spark, d).filter(F.col("type") == "nation")
    place = F.row_number().over(Window.orderBy(F.desc("degree"), "id"))
    return nations.select("id", "degree", F.when(place <= 3, "home").otherwise("foreign").alias("side"))


def sitemap_recursion(spark, d):
    """Depth of every node under its region: a recursive descent."""
    tables = {"region": table(spark, d, "region"), "nation": table(spark, d, "nation"), "supplier": table(spark, d, "supplier")}
    links = (
        tables["nation"].select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("child"))
        .unionAll(tables["supplier"].select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))))
    )
    roots = tables["region"].select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("url"))
    found = expand_sitemaps(links, roots).withColumn("depth", F.col("depth").cast("long"))
    return found.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (graph_nodes, graph_edges_dedup, graph_degree, graph_hub_threshold, graph_reorient, graph_expand_topk, home_institutions, sitemap_recursion)}

_EDGES = """
nodes AS (SELECT 'customer:' || c_custkey AS id, 'customer' AS type FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier' FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'part' FROM part UNION ALL SELECT 'nation:' || n_nationkey, 'nation' FROM nation),
raw AS (SELECT 'supplier:' || l_suppkey AS src, 'SUPPLIES' AS predicate, 'part:' || l_partkey AS dst, l_orderkey * 10 + l_linenumber AS pos FROM lineitem
  UNION ALL SELECT 'customer:' || o_custkey, 'BUYS', 'part:' || l_partkey, l_orderkey * 10 + l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  UNION ALL SELECT 'customer:' || c_custkey, 'IN', 'nation:' || c_nationkey, c_custkey FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'IN', 'nation:' || s_nationkey, s_suppkey FROM supplier),
edges AS (SELECT src, predicate, dst, min(pos) AS pos FROM raw WHERE src <> dst AND src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes) GROUP BY ALL),
ends AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges),
degree AS (SELECT id, type, coalesce(n, 0) AS degree FROM nodes LEFT JOIN (SELECT id, count(*) AS n FROM ends GROUP BY id) USING (id)),
sorted AS (SELECT list(degree ORDER BY degree) AS l FROM degree)"""

ORACLES = {
    "graph_nodes": """SELECT 'part:' || l_partkey AS id, count(*) AS fact_count, count(DISTINCT l_suppkey) AS source_count,
  array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS categories FROM lineitem GROUP BY 1""",
    "graph_edges_dedup": f"WITH {_EDGES} SELECT * FROM edges",
    "graph_degree": f"WITH {_EDGES} SELECT id, type, degree FROM degree",
    "graph_hub_threshold": f"WITH {_EDGES} SELECT CAST(greatest(60, l[CAST(floor(len(l) * 0.99) AS BIGINT) + 1] * 8) AS BIGINT) AS threshold FROM sorted",
    "graph_reorient": f"""WITH {_EDGES}, m AS (SELECT CASE WHEN pos % 7 = 0 THEN dst ELSE src END AS s, predicate, CASE WHEN pos % 7 = 0 THEN src ELSE dst END AS t FROM edges),
rules(predicate, a, o) AS (VALUES ('SUPPLIES', 'supplier', 'part'), ('BUYS', 'customer', 'part'), ('IN', 'customer', 'nation')),
x AS (SELECT m.predicate, EXISTS (SELECT 1 FROM rules r WHERE r.predicate = m.predicate AND a = split_part(s, ':', 1) AND o = split_part(t, ':', 1)) AS f,
  EXISTS (SELECT 1 FROM rules r WHERE r.predicate = m.predicate AND o = split_part(s, ':', 1) AND a = split_part(t, ':', 1)) AS b FROM m)
SELECT predicate, CASE WHEN f THEN 'keep' WHEN b THEN 'turn' ELSE 'drop' END AS action, count(*) AS n FROM x GROUP BY ALL""",
    "graph_expand_topk": f"""WITH {_EDGES}, t AS (SELECT greatest(40, l[CAST(floor(len(l) * 0.99) AS BIGINT) + 1]) AS threshold FROM sorted),
calm AS (SELECT id, degree FROM degree, t WHERE degree < threshold),
both_ways AS (SELECT src AS node, predicate, dst AS other, 'out' AS direction FROM edges UNION ALL SELECT dst, predicate, src, 'in' FROM edges),
chains AS (SELECT node AS unit, predicate, direction, other, calm.degree FROM both_ways JOIN nodes ON nodes.id = node AND type = 'supplier' JOIN calm ON calm.id = other),
one AS (SELECT *, CAST(row_number() OVER (PARTITION BY unit, predicate ORDER BY degree DESC, other, direction) > 1 AS INT) AS later FROM chains),
ranked AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY later, degree DESC, predicate, other, direction) AS rank FROM one)
SELECT unit, rank, predicate, direction, other, degree FROM ranked WHERE rank <= 2""",
    "home_institutions": f"""WITH {_EDGES} SELECT id, degree, CASE WHEN row_number() OVER (ORDER BY degree DESC, id) <= 3 THEN 'home' ELSE 'foreign' END AS side FROM degree WHERE type = 'nation'""",
    "sitemap_recursion": """WITH RECURSIVE links AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
walk AS (SELECT 'r' || r_regionkey AS node, 0::BIGINT AS depth FROM region UNION ALL SELECT child, depth + 1 FROM walk JOIN links ON parent = node WHERE depth < 4)
SELECT depth, count(*) AS n FROM walk GROUP BY depth""",
}
