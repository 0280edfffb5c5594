"""Secret scans by an incremental blob ledger, in DataFrame operations only.

Every historical version of a file is addressed by the SHA-256 of its content.
The ledger holds what each (blob, rule version) pair gave; a scan reads only the
pairs that the ledger lacks, each blob once however many paths hold it, and the
findings are joined back to all paths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import lower_ascii, salted_join, shared_path

RULE_VERSION = "3"

# The base rules in their order, then the rules this method adds.
NAMES = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = f"""({NAMES})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    # kind, pattern, least characters, group that they count in, words of which a text must hold one
    ("assign", ASSIGN, 12, 2, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    ("access", "AKIA[A-Z0-9]+", 18, 0, ("akia",)),
    ("hex", "[0-9a-f]{16,}", 16, 0, ()),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, 0, ("private key",)),
    # Bounded at the front: an unbounded run would be scanned again from each of its characters.
    ("jwt", "eyJ[A-Za-z0-9_-]{1,300}[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 20, 0, ("eyj",)),
    ("urlauth", "[a-z]{1,20}://[^\\x00-\\x20/:@]+:[^\\x00-\\x20/:@]+@", 8, 0, ("://",)),
)
BASE = ("assign", "access", "hex")


def _raw_matches(order: int, kind: str, pattern: str, hints: tuple[str, ...]) -> Column:
    """Leftmost non-overlapping matches, with the length of the text before each
    since the last: splitting at the pattern gives those pieces."""
    matches = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    lower = lower_ascii(F.col("text"))
    likely = reduce(lambda a, b: a | b, [lower.contains(h) for h in hints]) if hints else F.col("text").rlike(pattern)
    return F.when(likely, F.struct(
        F.lit(order).alias("ord"), F.lit(kind).alias("kind"), matches.alias("matches"),
        F.transform(F.split("text", pattern, -1), F.length).alias("gaps"),
    ))


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """(blob, text) to one row per blob with findings: blob, found, an array of
    (start, ord, kind, end) in code points, end exclusive, in order of start."""
    rules = F.array(*[_raw_matches(i, kind, pattern, hints) for i, (kind, pattern, _, _, hints) in enumerate(RULES)])
    least = F.create_map(*[x for kind, _, n, _, _ in RULES for x in (F.lit(kind), F.lit(n))])
    raw = (
        blobs.select("blob", F.explode(rules).alias("r"))
        .filter(F.col("r").isNotNull() & (F.size("r.matches") > 0))
        .select("blob", "r.ord", "r.kind", F.posexplode(F.arrays_zip("r.matches", "r.gaps")).alias("no", "m"))
        .select("blob", "ord", "kind", "no", F.col("m.matches").alias("match"), F.col("m.gaps").alias("gap"))
        .filter(F.col("match").isNotNull())
    )
    so_far = Window.partitionBy("blob", "ord").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    counted = F.when(F.col("kind") == "assign", F.length(F.regexp_extract("match", ASSIGN, 2))).otherwise(F.length("match"))
    return (
        raw.withColumn("length", F.length("match"))
        .withColumn("end", F.sum(F.col("gap") + F.col("length")).over(so_far))
        .filter(counted >= least[F.col("kind")])
        .select("blob", F.struct((F.col("end") - F.col("length")).alias("start"), "ord", "kind", "end").alias("span"))
        .groupBy("blob").agg(F.array_sort(F.collect_list("span")).alias("found"))
    )


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """New ledger rows (blob, rule_version, found) for the blobs of ``docs``
    that ``ledger`` has not under this rule version; blobs without findings get
    an empty array, so that they are not scanned again."""
    rows = keyed(docs, id_col, text_col).withColumn("at", F.xxhash64("doc_id", "blob"))
    fresh = rows.groupBy("blob").agg(F.min("at").alias("rep"))
    if ledger is not None:
        known = ledger.filter(F.col("rule_version") == rule_version).select("blob")
        fresh = fresh.join(known, "blob", "left_anti")
    # One document stands for each blob; joined by the hash of its id as well,
    # copies of a blob, however many, spread over the tasks and stay behind.
    # Rows that repeat its id (or its null) meet in one task: one of them stays.
    once = rows.join(
        fresh.select(F.col("blob").alias("b"), "rep").hint("shuffle_hash"),
        (rows["at"] == F.col("rep")) & (rows["blob"] == F.col("b")), "left_semi",
    ).select("at", "blob", "text").dropDuplicates(["at", "blob"])
    found = scan_blobs(once.select("blob", "text")).select("blob", F.array_distinct("found").alias("found"))
    return (
        fresh.select("blob").join(found, "blob", "left")
        .select("blob", F.lit(rule_version).alias("rule_version"),
                F.coalesce("found", F.array().cast("array<struct<start:bigint,ord:int,kind:string,end:bigint>>")).alias("found"))
    )


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


LEDGER = "blob binary, rule_version string, found array<struct<start:bigint,ord:int,kind:string,end:bigint>>"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows: those of all runs that appended to it; none if the path
    does not exist yet."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def scan_secrets(docs: DataFrame, ledger: str | None = None, rule_version: str = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings of every path (input row), scanning only what the ledger lacks.

    ``ledger`` is a folder of Parquet files in storage that all executors share.
    The blobs that it lacks under this rule version are scanned and appended
    first; then its findings are joined back to all paths.  Without a folder the
    ledger starts empty, in the cluster's shared folder, and goes with the
    session.  Two runs at once may append a blob twice; it counts once.

    Returns one row per input row: doc_id, n_assign, n_access, n_hex,
    base_sha256 and spans (kind:start:end by start, then rule order,
    comma-joined; code points, end exclusive).  A null text counts as empty,
    repeated rows and rows with a null id each get their row, other columns are
    ignored whatever their names, an empty table gives an empty result.  Texts
    may be long: no pattern scans a character more than a few hundred times.
    """
    spark = docs.sparkSession
    path = ledger or shared_path(spark, "secret-ledger")
    update_ledger(docs, read_ledger(spark, path), rule_version, id_col, text_col).write.mode("append").parquet(path)
    known = read_ledger(spark, path).filter((F.col("rule_version") == rule_version) & (F.size("found") > 0))
    found = known.groupBy("blob").agg(F.first("found").alias("found"))
    paths = keyed(docs, id_col, text_col).select("doc_id", "blob")
    joined = salted_join(paths, found, "blob", ["doc_id"], how="left")
    spans = F.coalesce("found", F.array().cast("array<struct<start:bigint,ord:int,kind:string,end:bigint>>"))
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return joined.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"),
    )
