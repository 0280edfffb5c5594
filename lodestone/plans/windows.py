"""Queries with order, caps, budgets and numbering."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import windows as W
from ..sources.tables import table


def host_cap_topn(spark, d):
    rows = W.cap_per_key(table(spark, d, "orders"), "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 3)
    best = rows.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(500)
    return best.select("o_orderkey", "o_custkey", "o_totalprice", F.col("place").cast("long").alias("place"))


def budget_fill(spark, d):
    out = W.budget_fill(table(spark, d, "orders"), "o_orderpriority", [F.desc("o_totalprice"), F.col("o_orderkey")], "o_totalprice", 5_000_000.0, 40)
    return out.select("o_orderkey", "o_orderpriority", "spent", F.col("place").cast("long").alias("place"))


def round_robin_batches(spark, d):
    return W.round_robin(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn", 20)


def fixed_batches(spark, d):
    """Batches of fifty within each status, rows already done left out."""
    orders = table(spark, d, "orders")
    done = orders.filter(F.col("o_orderkey") % 5 == 0).select("o_orderkey")
    todo = orders.join(done, "o_orderkey", "left_anti").select("o_orderkey", "o_orderstatus")
    return W.fixed_batches(todo, "o_orderstatus", "o_orderkey", 50)


def seeded_sample(spark, d):
    out = W.seeded_sample(table(spark, d, "documents"), "lang", "doc_id", 20, "7")
    return out.select("doc_id", "lang", F.col("place").cast("long").alias("place"))


def footnote_numbers(spark, d):
    rows = table(spark, d, "lineitem").withColumn("pos", F.col("l_partkey") * 10 + F.col("l_linenumber"))
    return W.first_appearance_numbers(rows, "l_orderkey", "l_suppkey", "pos").select("l_orderkey", "l_suppkey", "first_pos", "number")


def duplicate_headlines(spark, d):
    """A headline (every line of the documents) stays at its first chapter only."""
    rows = table(spark, d, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("headline", T.alnum_form(F.col("line"))).filter(F.col("headline") != "")
    chapter = F.when(F.col("lang") == "en", 1).when(F.col("lang") == "de", 2).when(F.col("lang") == "fr", 3).otherwise(4)
    # Partly aggregated before the shuffle: a line that every document repeats is one row a task.
    first = rows.groupBy("headline").agg(F.min(F.struct(chapter.alias("chapter"), "doc_id", "pos", "lang")).alias("first"), F.count(F.lit(1)).alias("n"))
    return first.groupBy(F.col("first.lang").alias("lang")).agg(F.count(F.lit(1)).alias("kept"), (F.sum("n") - F.count(F.lit(1))).alias("dropped"))


def section_carry(spark, d):
    """The last heading above each line: here the last user turn above a turn."""
    line = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(line)
    return table(spark, d, "conversations").select("conv_id", "turn", "role", heading.alias("section"))


def lookahead_names(spark, d):
    """The next block's name beside each block."""
    line = Window.partitionBy("p_brand").orderBy("p_partkey")
    return table(spark, d, "part").select("p_partkey", "p_brand", F.lead("p_name").over(line).alias("next_name"))


def group_sizes(spark, d):
    size = F.count(F.lit(1)).over(Window.partitionBy("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", size.alias("group_size"))


def first_wins_flatten(spark, d):
    """Buckets to one flat list: a unit that several list counts in the first."""
    rows = table(spark, d, "lineitem").select("l_partkey", F.col("l_returnflag").alias("bucket"), F.col("l_orderkey").alias("pos"), "l_linenumber")
    first = Window.partitionBy("l_partkey").orderBy("bucket", "pos", "l_linenumber")
    return rows.withColumn("rn", F.row_number().over(first)).filter("rn = 1").groupBy("bucket").agg(F.count(F.lit(1)).alias("units"))


def quota_seats(orders: DataFrame, per_host: int = 2, per_kind: int = 90, target: int = 200, width: float = 100.0) -> DataFrame:
    """Seats of each priority, dearest order first: urgent orders always, others
    under a cap for each customer and each status, up to a target.

    Urgent orders meet no cap, so their seats are ranks: counts of each stretch
    of prices give the offsets, and no task sorts them all.  The others are
    picked one after the other in one task for each priority, from a shortlist
    that gives the same seats.  An order that a cap refuses stays refused, so of
    a customer's orders of one priority and status only the first ``per_host``
    can get a seat.  At most ``target // per_host`` customers get full, so at most
    ``target`` orders of that shortlist are refused for their customer; of the
    first ``target + per_kind`` of a status the rest fill it or meet the target.
    """
    keep = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    dearest = [F.desc("o_totalprice"), F.col("o_orderkey")]
    urgent = F.col("o_orderpriority").startswith("1")
    out = "o_orderkey long, o_orderpriority string, seat int"

    placed = keep.filter(urgent).withColumn("stretch", F.floor(-F.col("o_totalprice") / width))
    counts = placed.groupBy("o_orderpriority", "stretch").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("o_orderpriority").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("o_orderpriority", "stretch", F.coalesce(before, F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("o_orderpriority", "stretch").orderBy(*dearest))
    always = placed.join(offsets, ["o_orderpriority", "stretch"]).select("o_orderkey", "o_orderpriority", (F.col("offset") + within).cast("int").alias("seat"))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        hosts: dict = {}
        kinds: dict = {}
        out = []
        for r in pdf.sort_values(["o_totalprice", "o_orderkey"], ascending=[False, True]).itertuples():
            if len(out) >= target or hosts.get(r.o_custkey, 0) >= per_host or kinds.get(r.o_orderstatus, 0) >= per_kind:
                continue
            hosts[r.o_custkey] = hosts.get(r.o_custkey, 0) + 1
            kinds[r.o_orderstatus] = kinds.get(r.o_orderstatus, 0) + 1
            out.append(r.o_orderkey)
        return pd.DataFrame({"o_orderkey": out, "o_orderpriority": pdf["o_orderpriority"].iloc[0], "seat": range(1, len(out) + 1)})

    short = W.cap_per_key(keep.filter(~urgent), ["o_orderpriority", "o_orderstatus", "o_custkey"], dearest, per_host)
    short = W.cap_per_key(short, ["o_orderpriority", "o_orderstatus"], dearest, target + per_kind).drop("place")
    return always.unionByName(short.groupBy("o_orderpriority").applyInPandas(pick, out))


def quota_pick(spark, d):
    """Greedy quotas for each priority over all orders."""
    return quota_seats(table(spark, d, "orders"))


QUERIES = {f.__name__: f for f in (
    host_cap_topn, budget_fill, round_robin_batches, fixed_batches, seeded_sample, footnote_numbers, duplicate_headlines,
    section_carry, lookahead_names, group_sizes, first_wins_flatten, quota_pick)}

ORACLES = {
    "host_cap_topn": """SELECT o_orderkey, o_custkey, o_totalprice, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders)
  WHERE place <= 3 ORDER BY o_totalprice DESC, o_orderkey LIMIT 500""",
    "budget_fill": """SELECT o_orderkey, o_orderpriority, spent, place FROM (SELECT *, round(sum(o_totalprice) OVER w, 2) AS spent, row_number() OVER w AS place FROM orders
  WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey ROWS UNBOUNDED PRECEDING)) WHERE place <= 40 AND spent <= 5000000""",
    "round_robin_batches": """WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS round FROM conversations)
SELECT *, CAST(floor((row_number() OVER (PARTITION BY round ORDER BY conv_id) - 1) / 20) AS BIGINT) AS batch FROM r""",
    "fixed_batches": """WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS p FROM orders WHERE o_orderkey % 5 <> 0)
SELECT o_orderkey, o_orderstatus, p // 50 AS batch, p % 50 AS index FROM r""",
    "seeded_sample": """SELECT doc_id, lang, place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '7'), doc_id) AS place FROM documents) WHERE place <= 20""",
    "footnote_numbers": """WITH f AS (SELECT l_orderkey, l_suppkey, min(l_partkey * 10 + l_linenumber) AS first_pos FROM lineitem GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY first_pos, l_suppkey) AS number FROM f""",
    "duplicate_headlines": """WITH h AS (SELECT lang, doc_id, pos, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END AS chapter,
  trim(regexp_replace(lower(translate(l[pos], '’‘“”–—' || chr(160), '''''""-- ')), '[^a-z0-9]+', ' ', 'g')) AS headline
  FROM (SELECT *, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents)),
f AS (SELECT *, count(*) OVER (PARTITION BY headline) AS n FROM h WHERE headline <> '' QUALIFY row_number() OVER (PARTITION BY headline ORDER BY chapter, doc_id, pos) = 1)
SELECT lang, count(*) AS kept, CAST(sum(n) - count(*) AS BIGINT) AS dropped FROM f GROUP BY lang""",
    "section_carry": """SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations""",
    "lookahead_names": "SELECT p_partkey, p_brand, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS next_name FROM part",
    "group_sizes": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS group_size FROM orders",
    "first_wins_flatten": """SELECT l_returnflag AS bucket, count(*) AS units FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag, l_orderkey, l_linenumber) = 1) GROUP BY 1""",
}
