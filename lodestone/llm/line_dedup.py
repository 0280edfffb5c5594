"""Line dedup: explode normalised lines, hash them, count documents for each
hash, drop lines over the threshold and put the rest together by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import cut, join_rows, lower_ascii, salted_join, text_key

BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """What makes two lines the same: blanks stripped at both ends, A-Z lowered."""
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1, min_docs: int = 10, keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents without the lines that ``min_docs`` or more documents share.

    Returns one row per input row: doc_id, n_lines, n_dropped, kept (text), and
    the input's columns ``keep``.
    A null or empty text is one empty line; lines whose key is shorter than
    ``min_chars`` always stay.  A document counts once for each key; rows that
    repeat an id count as one document, and so do all rows with a null id.
    Other columns are ignored whatever their names, an empty table gives an empty
    result, and a very long text is split like any other.

    Lines are hashed once and written as (id, place, 16-byte hash); counts and
    the search for hits read those only, hot ones partly counted before the
    shuffle.  Texts move once, split into lines.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    lines = cut(
        rows.select("doc_id", text_key(), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .select("doc_id", "th", "pos", line_key(F.col("line")).alias("norm"))
        .filter(F.length("norm") >= min_chars)
        .select("doc_id", "th", "pos", F.unhex(F.md5("norm")).alias("key")),
        "line-keys",
    )
    repeated = (
        lines.select("key", "doc_id").distinct()
        .groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_docs).select("key")
    )
    hits = (
        salted_join(lines, repeated, "key", ["doc_id", "pos"])
        .groupBy("doc_id", "th").agg(F.collect_set("pos").alias("bad"))
    )
    split = rows.select("doc_id", text_key(), F.split("text", "\n").alias("lines"), *[f"keep_{c}" for c in keep])
    joined = join_rows(split, hits, hash_right=True)
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("bad"))
    kept = F.when(F.col("bad").isNull(), F.col("lines")).otherwise(F.transform(places, lambda i: F.get(F.col("lines"), i)))
    return joined.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("bad"), F.lit(0)).cast("long").alias("n_dropped"),
        F.array_join(kept, "\n").alias("kept"),
        *[F.col(f"keep_{c}").alias(c) for c in keep],
    )
