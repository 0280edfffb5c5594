"""File sources: JSON lines, page folders, graph CSV, robots rules, sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PAGE = "url string, status string, fetched_at string, title string, markdown string, links array<string>, meta struct<bucket: string, priority: int>"
FETCH_LOG = "t string, url string, status string, api_http int, credits double, chars long, bucket string"


def json_lines(spark: SparkSession, path: str, schema: str | StructType, allow_empty: bool = False) -> DataFrame:
    """JSON lines of a declared schema; a malformed line aborts the read, and so
    does a file without rows unless allowed."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if not allow_empty and rows.isEmpty():
        raise ValueError(f"no rows in {path}")
    return rows


def fetched_pages(spark: SparkSession, path: str, structured: str | None = None) -> DataFrame:
    """Pages that came through with text; addresses matching ``structured`` go
    to their own parsers and are left out here."""
    pages = spark.read.schema(PAGE).json(path).filter((F.col("status") == "ok") & (F.coalesce(F.length("markdown"), F.lit(0)) > 0))
    return pages.filter(~F.col("url").rlike(structured)) if structured else pages


def fetch_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FETCH_LOG).json(path).withColumn("ts", F.try_to_timestamp("t"))


def graph_csv(spark: SparkSession, nodes: str, edges: str, skip: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges: trimmed, predicates in upper case, incomplete rows and
    the predicates ``skip`` left out."""
    read = lambda p: spark.read.option("header", True).csv(p)
    clean = lambda df: df.select(*[F.trim(F.col(c)).alias(c) for c in df.columns])
    n = clean(read(nodes)).filter((F.col("id") != "") & (F.col("name") != ""))
    e = clean(read(edges)).withColumn("predicate", F.upper("predicate"))
    e = e.filter((F.col("src") != "") & (F.col("dst") != "") & (F.col("predicate") != ""))
    return n, e.filter(~F.col("predicate").isin(*skip)) if skip else e


def robots_rules(files: DataFrame, host: str = "host", body: str = "body") -> DataFrame:
    """Rules of the group for all agents: host, pos, verdict, pattern, delay.

    A group is a run of user-agent lines and the rules after it, so a line opens
    a group if it is a user-agent line and the line before it is none.
    """
    from pyspark.sql import Window

    lines = (
        files.select(F.col(host).alias("host"), F.posexplode(F.split(body, "\r?\n")).alias("pos", "line"))
        .withColumn("line", F.trim(F.regexp_replace("line", "#.*$", "")))
        .withColumn("field", F.lower(F.trim(F.regexp_extract("line", "^([A-Za-z-]+)\\s*:", 1))))
        .withColumn("value", F.trim(F.regexp_extract("line", "^[A-Za-z-]+\\s*:(.*)$", 1)))
        .filter(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay"))
    )
    line = Window.partitionBy("host").orderBy("pos")
    agent = F.col("field") == "user-agent"
    opened = agent & (F.coalesce(F.lag("field").over(line), F.lit("")) != "user-agent")
    grouped = lines.withColumn("opened", opened.cast("int")).withColumn("grp", F.sum("opened").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    ours = F.max(F.when(agent & (F.col("value") == "*"), 1).otherwise(0)).over(Window.partitionBy("host", "grp"))
    kept = grouped.withColumn("ours", ours).filter((F.col("ours") == 1) & ~agent)
    delay = F.max(F.when(F.col("field") == "crawl-delay", F.col("value").try_cast("double"))).over(Window.partitionBy("host"))
    return kept.withColumn("delay", delay).filter(F.col("field").isin("allow", "disallow") & (F.col("value") != "")).select(
        "host", "pos", F.col("field").alias("verdict"), F.col("value").alias("pattern"), "delay")


def robots_regex(pattern: Column) -> Column:
    """A robots pattern as a regular expression: * any run, $ the end."""
    quoted = F.regexp_replace(pattern, "([.+?^(){}\\[\\]|\\\\])", "\\\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, "\\*", ".*"))


def allowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, host, path) with allowed: the longest matching pattern decides, an
    allow wins a tie, no rule allows.  The join runs on the host."""
    hit = pages.join(rules.withColumn("rx", robots_regex(F.col("pattern"))).select(F.col("host").alias("h"), "verdict", "pattern", "rx"),
                     (F.col("host") == F.col("h")) & F.expr("path rlike rx"), "left")
    best = hit.groupBy("url", "host", "path").agg(F.max(F.struct(F.length("pattern").alias("n"), (F.col("verdict") == "allow").alias("ok"))).alias("b"))
    return best.select("url", "host", "path", F.coalesce("b.ok", F.lit(True)).alias("allowed"))


def expand_sitemaps(index: DataFrame, roots: DataFrame, most_depth: int = 4) -> DataFrame:
    """Addresses below the roots of (parent, child, is_index) rows, each at its
    smallest depth; cycles end because known addresses do not descend again."""
    level = roots.select(F.col("url").alias("node"), F.lit(0).alias("depth"))
    found = level
    for depth in range(1, most_depth + 1):
        level = (
            index.join(level, F.col("parent") == F.col("node")).select(F.col("child").alias("node"), F.lit(depth).alias("depth")).distinct()
            .join(found.select("node"), "node", "left_anti")
        )
        found = found.unionAll(level)
    return found
