"""Reports and gates: personalisation, matrices, drift, ledgers, rubric scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import quality as Q
from ..sources.tables import table


def jaccard_personalisation(spark, d):
    """Profiles are nations (few, so pairs of them are), categories order
    priorities, units the parts that a nation's customers bought."""
    orders = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = orders.join(table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return Q.mean_pairwise_jaccard(rows, "c_nationkey", "o_orderpriority", "l_partkey")


def division_matrix(spark, d):
    """Pivot of documents by source and language, with distinct openings."""
    docs = table(spark, d, "documents").withColumn("opening", T.first_word(F.col("text")))
    counts = [F.count_if(F.col("lang") == lang).alias(lang) for lang in ("de", "en", "es", "fr")]
    return docs.groupBy("source").agg(*counts, F.count(F.lit(1)).alias("units"), F.countDistinct("opening").alias("openings"))


def readiness_gates(spark, d):
    """Gate rows: part, name, ok, from one pass over the documents."""
    docs = table(spark, d, "documents")
    m = docs.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("hosts"), F.count_if(F.length("text") < 40).alias("short"),
                 F.countDistinct(F.unhex(F.md5("text"))).alias("distinct_texts"))
    return m.select(F.explode(F.array(
        F.struct(F.lit("A").alias("part"), F.lit("units").alias("name"), (F.col("n") >= 100).alias("ok")),
        F.struct(F.lit("A").alias("part"), F.lit("hosts").alias("name"), (F.col("hosts") >= 10).alias("ok")),
        F.struct(F.lit("B").alias("part"), F.lit("short_rate").alias("name"), (F.col("short") * 100 < F.col("n") * 5).alias("ok")),
        F.struct(F.lit("E").alias("part"), F.lit("distinct_rate").alias("name"), (F.col("distinct_texts") * 100 >= F.col("n") * 95).alias("ok")),
    )).alias("g")).select("g.part", "g.name", "g.ok")


def run_compare(spark, d):
    """Two runs of prices: the second lacks every ninth row, has changed others."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    old = orders.filter(F.col("o_orderkey") % 11 != 0)
    new = orders.filter(F.col("o_orderkey") % 9 != 0).withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice")))
    return Q.compare_runs(old, new, "o_orderkey", "o_totalprice").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def set_drift(spark, d):
    """Sizes of intersection and differences of two runs' keys."""
    lines = table(spark, d, "lineitem")
    a = lines.filter(F.col("l_returnflag") == "R").select("l_partkey").distinct()
    b = lines.filter(F.col("l_returnflag") == "A").select("l_partkey").distinct()
    count = lambda df, name: df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
    return count(a.intersect(b), "both").unionAll(count(a.exceptAll(b), "only_first")).unionAll(count(b.exceptAll(a), "only_second"))


def right_preferred_merge(spark, d):
    """Two record lists merged on a key, the second list winning."""
    base = table(spark, d, "part").select("p_partkey", "p_name", F.col("p_retailprice").alias("price"))
    extra = base.filter(F.col("p_partkey") % 3 == 0).withColumn("price", F.col("price") + 1)
    e = extra.withColumnsRenamed({"p_name": "x_name", "price": "x_price"})
    return base.join(e, "p_partkey", "full").select("p_partkey", F.coalesce("x_name", "p_name").alias("p_name"), F.round(F.coalesce("x_price", "price"), 2).alias("price"))


def best_record(spark, d):
    """The record with most sections for each key: part lines with largest quantity."""
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.max_by("l_orderkey", F.struct("l_quantity", -F.col("l_orderkey"), -F.col("l_linenumber"))).alias("best_order"), F.max("l_quantity").alias("quantity"))


def nested_sections(spark, d):
    """Orders with nested lines, then the totals of the first line type present."""
    lines = table(spark, d, "lineitem")
    nested = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_quantity"))).alias("sections"))
    kept = F.filter("sections", lambda s: s["l_returnflag"] == "R")
    use = F.when(F.size(kept) > 0, kept).otherwise(F.col("sections"))
    return nested.select("l_orderkey", F.size("sections").cast("long").alias("n"), F.aggregate(use, F.lit(0.0), lambda a, s: a + s["l_quantity"]).alias("seats"))


def prevalent_brand(spark, d):
    """The most frequent value of each group, ties to the smaller one."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    counts = rows.groupBy("l_suppkey", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    place = Window.partitionBy("l_suppkey").orderBy(F.desc("n"), "p_brand")
    return counts.withColumn("rn", F.row_number().over(place)).filter("rn = 1").select("l_suppkey", "p_brand", "n")


def term_df(spark, d):
    """Units holding each query term, and terms that are neither too rare nor too common."""
    docs = table(spark, d, "documents")
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    df = docs.select(F.explode(F.array_distinct(T.words(F.col("text"), 4))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).filter((F.col("df") >= 3) & (F.col("df") <= F.greatest(F.lit(25), F.col("n") * 0.05))).select("term", "df")


def claim_states(spark, d):
    """The claim state machine over every combination of its inputs."""
    grid = spark.range(1).select()
    for name, values in (("det1", ("non_factual", "hard", "soft", "grounded", "clean")), ("model1", ("supported", "overreach", "unsupported", None)),
                         ("cand", ("y", "n")), ("det2", ("clean", "hard")), ("model2", ("supported", "unsupported"))):
        grid = grid.select("*", F.explode(F.array(*[F.lit(v).cast("string") for v in values])).alias(name))
    return grid.withColumn("verdict", Q.claim_state(F.col("det1"), F.col("model1"), F.col("cand") == "y", F.col("det2"), F.col("model2")))


def verification_ledger(spark, d):
    """Counts and rates by role of the turns that cite, quote or number something."""
    t = table(spark, d, "conversations")
    return t.groupBy("role").agg(
        F.count(F.lit(1)).alias("claims"), F.count_if(F.col("text").rlike("[0-9]")).alias("numbered"),
        F.count_if(F.length("text") < 40).alias("short"), F.round(F.count_if(F.col("text").rlike("[0-9]")) / F.count(F.lit(1)), 6).alias("rate"))


def undergraduate_flags(spark, d):
    number = F.lpad((F.col("p_partkey") % 700).cast("string"), 4, "0")
    return table(spark, d, "part").select("p_partkey", Q.undergraduate_number(number).alias("undergraduate"))


def rubric_scores(spark, d):
    docs = table(spark, d, "documents").select(
        "doc_id", (F.length("text") >= 200).alias("long"), F.col("text").contains("\n").alias("lined"), (T.latest_year(F.col("text")) >= 2000).alias("dated"))
    return docs.select("doc_id", Q.rubric({"long": 5.0, "lined": 3.0, "dated": 4.0}).alias("score"))


def theme_strength(spark, d):
    """Own weight plus the weights of all other entries that share a word, with
    no pair of entries ever formed: sums over every set of words that an entry's
    words contain, added and subtracted in turn, count each other entry once."""
    parts = table(spark, d, "part").select("p_partkey", "p_size", F.array_sort(F.array_distinct(T.words(F.col("p_name"), 4))).alias("words"))
    return Q.shared_word_strength(parts, "p_partkey", "words", "p_size").select("p_partkey", "strength")


def json_props(spark, d):
    """Typed reads of the JSON column, tolerant of other shapes."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, d, "events").select(k.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def worst_pages(spark, d):
    """The thirty lowest-rated rows in order, with the number of all that fail."""
    lab = table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    docs = table(spark, d, "documents").join(lab, "doc_id", "left")
    bad = docs.filter((F.col("quality") == 0) | (F.length("text") < 40)).select("doc_id", F.length("text").cast("long").alias("n"))
    total = bad.agg(F.count(F.lit(1)).alias("total"))
    return bad.orderBy("n", "doc_id").limit(30).crossJoin(F.broadcast(total))


QUERIES = {f.__name__: f for f in (
    jaccard_personalisation, division_matrix, readiness_gates, run_compare, set_drift, right_preferred_merge, best_record, nested_sections,
    prevalent_brand, term_df, claim_states, verification_ledger, undergraduate_flags, rubric_scores, theme_strength, json_props, worst_pages)}

_W4 = "regexp_extract_all(lower({}), '[a-z0-9]{{4,}}')"
ORACLES = {
    "jaccard_personalisation": """WITH s AS (SELECT DISTINCT o_orderpriority AS category, c_nationkey AS p, l_partkey AS u FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey),
g AS (SELECT category, p, list(u) AS l FROM s GROUP BY ALL)
SELECT a.category, round(avg(len(list_intersect(a.l, b.l)) / len(list_distinct(list_concat(a.l, b.l)))), 6) AS mean_jaccard FROM g a JOIN g b ON a.category = b.category AND a.p < b.p GROUP BY 1""",
    "division_matrix": """SELECT source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr,
  count(*) AS units, count(DISTINCT regexp_extract_all(lower(text), '[a-z0-9]+')[1]) AS openings FROM documents GROUP BY source""",
    "readiness_gates": """WITH m AS (SELECT count(*) AS n, count(DISTINCT source) AS hosts, count(*) FILTER (length(text) < 40) AS short, count(DISTINCT text) AS t FROM documents)
SELECT 'A' AS part, 'units' AS name, n >= 100 AS ok FROM m UNION ALL SELECT 'A', 'hosts', hosts >= 10 FROM m UNION ALL SELECT 'B', 'short_rate', short * 100 < n * 5 FROM m UNION ALL SELECT 'E', 'distinct_rate', t * 100 >= n * 95 FROM m""",
    "run_compare": """WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 11 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 9 <> 0)
SELECT CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'gone' WHEN a.v = b.v THEN 'kept' ELSE 'changed' END AS state, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""",
    "set_drift": """WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A')
SELECT 'both' AS part, count(*) AS n FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'only_first', count(*) FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'only_second', count(*) FROM (FROM b EXCEPT FROM a)""",
    "right_preferred_merge": "SELECT p_partkey, p_name, round(p_retailprice + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END, 2) AS price FROM part",
    "best_record": """SELECT l_partkey, l_orderkey AS best_order, l_quantity AS quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1""",
    "nested_sections": """SELECT l_orderkey, count(*) AS n, CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN sum(l_quantity) FILTER (l_returnflag = 'R') ELSE sum(l_quantity) END AS seats FROM lineitem GROUP BY 1""",
    "prevalent_brand": """SELECT l_suppkey, p_brand, n FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, p_brand) AS rn FROM
  (SELECT l_suppkey, p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)) WHERE rn = 1""",
    "term_df": f"""WITH d AS (SELECT unnest(list_distinct({_W4.format('text')})) AS term FROM documents) SELECT term, count(*) AS df FROM d GROUP BY term
  HAVING count(*) >= 3 AND count(*) <= greatest(25, (SELECT count(*) FROM documents) * 0.05)""",
    "claim_states": """WITH g AS (SELECT * FROM (VALUES ('non_factual'), ('hard'), ('soft'), ('grounded'), ('clean')) a(det1), (VALUES ('supported'), ('overreach'), ('unsupported'), (NULL)) b(model1),
  (VALUES ('y'), ('n')) c(cand), (VALUES ('clean'), ('hard')) e(det2), (VALUES ('supported'), ('unsupported')) f(model2)),
x AS (SELECT *, CASE WHEN cand = 'y' AND det2 = 'clean' AND model2 = 'supported' THEN 'corrected' ELSE 'unsupported' END AS c2 FROM g)
SELECT det1, model1, cand, det2, model2, CASE WHEN det1 = 'non_factual' THEN 'supported' WHEN det1 = 'hard' THEN 'unsupported'
  WHEN model1 IS NULL THEN CASE WHEN det1 = 'grounded' THEN 'supported' ELSE 'unsupported' END WHEN model1 = 'unsupported' THEN 'unsupported'
  WHEN model1 = 'overreach' THEN c2 WHEN det1 = 'soft' THEN c2 ELSE 'supported' END AS verdict FROM x""",
    "verification_ledger": """SELECT role, count(*) AS claims, count(*) FILTER (regexp_matches(text, '[0-9]')) AS numbered, count(*) FILTER (length(text) < 40) AS short,
  round(count(*) FILTER (regexp_matches(text, '[0-9]')) / count(*), 6) AS rate FROM conversations GROUP BY role""",
    "undergraduate_flags": """SELECT p_partkey, CASE WHEN p = '' THEN NULL ELSE p[1] BETWEEN '0' AND '4' END AS undergraduate FROM (SELECT p_partkey,
  regexp_replace(lpad(CAST(p_partkey % 700 AS VARCHAR), 4, '0'), '^0+', '') AS p FROM part)""",
    "rubric_scores": """SELECT doc_id, least(10.0, CASE WHEN length(text) >= 200 THEN 5.0 ELSE 0 END + CASE WHEN contains(text, chr(10)) THEN 3.0 ELSE 0 END
  + CASE WHEN list_max(list_transform(regexp_extract_all(text, '(19[5-9][0-9]|20[0-3][0-9])'), lambda y: CAST(y AS INT))) >= 2000 THEN 4.0 ELSE 0 END)::DOUBLE AS score FROM documents""",
    "theme_strength": f"""WITH w AS (SELECT p_partkey, unnest(list_distinct({_W4.format('p_name')})) AS word, p_size AS w FROM part),
s AS (SELECT DISTINCT a.p_partkey, b.p_partkey AS other, b.w AS w2 FROM w a JOIN w b ON a.word = b.word AND a.p_partkey <> b.p_partkey),
m AS (SELECT p_partkey, sum(w2) AS more FROM s GROUP BY 1)
SELECT p.p_partkey, CAST(p_size + coalesce(more, 0) AS BIGINT) AS strength FROM part p LEFT JOIN m ON m.p_partkey = p.p_partkey""",
    "json_props": "SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY 1",
    "worst_pages": """WITH b AS (SELECT d.doc_id, CAST(length(text) AS BIGINT) AS n FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS q FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id WHERE q = 0 OR length(text) < 40)
SELECT doc_id, n, (SELECT count(*) FROM b) AS total FROM b ORDER BY n, doc_id LIMIT 30""",
}
