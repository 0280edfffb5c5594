"""Entity graph: nodes, edges, direction repair, degree, hubs, one-hop chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def node_key(kind, name):
    return F.concat(kind, F.lit(":"), F.lower(F.trim(F.regexp_replace(name, "[ \\t]+", " "))))


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """The first edge of each (src, predicate, dst) by pos, without self loops."""
    keys = ["src", "predicate", "dst"]
    rest = [c for c in edges.columns if c not in (*keys, "pos")]
    grouped = edges.filter(F.col("src") != F.col("dst")).groupBy(*keys)
    # Partly aggregated before the shuffle, which row numbers would not be.
    if not rest:
        return grouped.agg(F.min("pos").alias("pos"))
    return grouped.agg(F.min(F.struct("pos", *rest)).alias("first")).select(*keys, "first.*")


def resolve_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes; others and self loops go."""
    known = nodes.select("id")
    return (
        edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi")
        .join(known.withColumnRenamed("id", "dst"), "dst", "left_semi").filter(F.col("src") != F.col("dst"))
    )


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In- plus out-degree of every node; isolated ones 0."""
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id")))
    return nodes.join(ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree")), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def hub_threshold(with_degree: DataFrame, share: float = 0.99, times: int = 8, floor: int = 60) -> DataFrame:
    """``times`` the degree at place floor(n * share) of the ascending order, at
    least ``floor``.  Degrees are few distinct values: a histogram and a running
    count find the place without sorting the nodes."""
    histogram = with_degree.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    so_far = Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0)
    placed = histogram.withColumn("upto", F.sum("n").over(so_far)).withColumn("total", F.sum("n").over(Window.partitionBy()))
    at = placed.filter(F.col("upto") > F.floor(F.col("total") * share)).agg(F.min("degree").alias("at"))
    return at.select(F.greatest(F.lit(floor), F.col("at") * times).cast("long").alias("threshold"))


def reorient(edges: DataFrame, signatures: DataFrame) -> DataFrame:
    """Direction repair by type signature.  ``signatures`` lists for a predicate
    which node types can act and which can be acted on; an edge is kept if its
    ends fit, turned if only the turned edge fits, dropped if neither does, and
    left alone where the predicate or a type is unknown."""
    ok = signatures.select("predicate", "actor", "object", F.lit(True).alias("fits"))
    turned = ok.select("predicate", F.col("actor").alias("object"), F.col("object").alias("actor"), F.col("fits").alias("fits_turned"))
    named = signatures.select("predicate").distinct().withColumn("ruled", F.lit(True))
    typed = edges.withColumnsRenamed({"src_type": "actor", "dst_type": "object"})
    joined = typed.join(F.broadcast(ok), ["predicate", "actor", "object"], "left").join(F.broadcast(turned), ["predicate", "actor", "object"], "left").join(F.broadcast(named), "predicate", "left")
    action = (
        F.when(F.col("ruled").isNull() | F.col("actor").isNull() | F.col("object").isNull(), "keep")
        .when(F.col("fits"), "keep").when(F.col("fits_turned"), "turn").otherwise("drop")
    )
    return joined.withColumn("action", action).withColumnsRenamed({"actor": "src_type", "object": "dst_type"}).drop("fits", "fits_turned", "ruled")


def expand(anchors: DataFrame, edges: DataFrame, nodes: DataFrame, threshold: DataFrame, per_unit: int = 2) -> DataFrame:
    """One-hop chains of each anchor (unit, node): neighbours that are no hubs,
    at most one per predicate first, then the best of the rest up to
    ``per_unit``.  Hubs leave before the join, which also keeps it even."""
    calm = nodes.crossJoin(F.broadcast(threshold)).filter(F.col("degree") < F.col("threshold")).select("id", "degree")
    both = edges.select(F.col("src").alias("node"), "predicate", F.col("dst").alias("other"), F.lit("out").alias("direction")).unionAll(
        edges.select(F.col("dst").alias("node"), "predicate", F.col("src").alias("other"), F.lit("in").alias("direction")))
    chains = anchors.join(both, "node").join(calm.withColumnsRenamed({"id": "other"}), "other")
    one = Window.partitionBy("unit", "predicate").orderBy(F.desc("degree"), "other", "direction")
    every = Window.partitionBy("unit").orderBy("later", F.desc("degree"), "predicate", "other", "direction")
    return (
        chains.withColumn("later", (F.row_number().over(one) > 1).cast("int"))
        .withColumn("rank", F.row_number().over(every)).filter(F.col("rank") <= per_unit)
        .select("unit", "rank", "predicate", "direction", "other", "degree")
    )
