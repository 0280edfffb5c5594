"""Benchmark decontamination by a prefix-filtered join.

Each window of an item (8 consecutive words, or the whole of a shorter item) is
a record of words ordered by rarity in the whole corpus.  Containment must be
complete, so the necessary prefix of a record is its rarest word alone: a
document can hold the window only where it holds that word.  The two are joined
on it.  The word's offset gives the only possible start (positional bound), start
and end must lie inside the document (length bound), and the item-sized window
is verified word by word.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import WordHashes, binary_column, cut, join_rows, lower_ascii, salted_join, slices, text_key, words_of

FILTER_BITS = 23
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_windows(bench: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """Distinct windows: win (array of words), items (sorted ids as strings)."""
    words = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(WORD), F.lit(0))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)))
    return (
        bench.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
        .filter(F.col("item").isNotNull())
        .select("item", words.alias("words")).filter(F.size("words") > 0)
        .select("item", "words", F.explode(starts).alias("at"))
        .select("item", F.slice("words", F.col("at") + 1, F.lit(size)).alias("win"))
        .groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n): how often each word stands in all texts, partly counted in the
    workers, each holding some hundred thousand words at most."""

    def count(batches):
        import pyarrow as pa

        seen: dict[bytes, int] = {}
        for batch in slices(batches):
            for text in binary_column(batch, "text"):
                for word in words_of(text):
                    seen[word] = seen.get(word, 0) + 1
                if len(seen) > 300_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
                    seen = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return rows.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def filter_of(words: DataFrame) -> np.ndarray:
    """A bit for each of 2**23 hash values that some word has: a megabyte however
    many words there are.  A word without its bit is none of them."""

    def mark(batches):
        import pyarrow as pa

        hashes, bits = WordHashes(), np.zeros(1 << FILTER_BITS, bool)
        for batch in slices(batches, 4096):
            bits[(hashes.of(binary_column(batch, "word")) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        at = np.flatnonzero(np.packbits(bits).view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.packbits(bits).view(np.int64)[at], pa.int64())], ["at", "bits"])

    found = words.select("word").mapInArrow(mark, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    packed = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    packed[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return np.unpackbits(packed.view(np.uint8)).astype(bool)


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 8, min_items: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """Benchmark items found in each document.

    Returns one row per input row: doc_id, n_words, n_hit (words inside any
    occurrence of a window), n_items (items with an occurring window), items
    (their ids as sorted strings, comma-joined), items_sha256, contaminated
    (n_items >= ``min_items``), and the input's columns ``keep``.  Null or
    wordless texts have no words; items without words or with a null id never
    match; repeated items count once.  Repeated rows and rows with a null id each
    get their row; other columns are ignored whatever their names; empty tables
    give an empty result or no hits.  Of a long text only the words around
    possible prefixes travel.

    A filter of one megabyte keeps the places of prefix words, with the words
    around each; they meet the windows in a salted join on the word, and the
    window is verified among the words around.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c) for c in keep if c not in (id_col, text_col)])
    windows = item_windows(bench, item_col, item_text_col, window).withColumn("win_id", F.unhex(F.md5(F.array_join("win", " "))))
    windows = cut(windows, "windows")
    tokens = windows.select("win_id", F.posexplode("win").alias("offset", "word"))
    rarity = word_counts(rows).join(tokens.select("word").distinct(), "word", "left_semi")
    # A window with a word that no document has occurs nowhere.
    rarest = tokens.join(rarity, "word", "left").groupBy("win_id").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")).alias("p")).filter(F.col("p.n") > 0)
    prefix = cut(windows.join(rarest, "win_id").select("win", "items", F.col("p.word").alias("word"), F.col("p.offset").alias("offset")), "window-prefixes")
    bits = filter_of(prefix)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def places(batches):
        import pyarrow as pa

        hashes = WordHashes()
        for batch in slices(batches):
            row, n, at, spot, before, around = [], [], [], [], [], []
            for i, text in enumerate(binary_column(batch, "text")):
                words = words_of(text)
                starts = np.flatnonzero(bits[(hashes.of(words) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]).tolist() if words else []
                # The first row of each text has its length and no word.
                row += [i] * (len(starts) + 1)
                n += [len(words)] * (len(starts) + 1)
                at += [0, *(max(0, j - window + 1) for j in starts)]
                spot += [None, *(words[j] for j in starts)]
                before += [0, *(min(j, window - 1) for j in starts)]
                around += [None, *(words[max(0, j - window + 1) : j + window] for j in starts)]
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(n, pa.int64()), pa.array(spot, pa.binary()).cast(pa.string()), pa.array(at, pa.int32()),
                 pa.array(before, pa.int32()), pa.array(around, pa.list_(pa.binary())).cast(pa.list_(pa.string()))],
                ["doc_id", "th", "n", "word", "at", "before", "around"],
            )

    spots = rows.select("doc_id", text_key(), "text").mapInArrow(places, f"doc_id {kind}, th long, n long, word string, at int, before int, around array<string>")
    spots = cut(spots, "prefix-places")
    start = F.col("before") - F.col("offset")
    hits = (
        salted_join(spots.filter(F.col("word").isNotNull()), prefix, "word", ["doc_id", "at"])
        .filter((start >= 0) & (start + F.size("win") <= F.size("around")))
        .filter(F.slice("around", start + 1, F.size("win")) == F.col("win"))
        .select("doc_id", "th", "n", (F.col("at") + start).alias("start"), F.size("win").alias("len"), "items")
    )
    lengths = spots.filter(F.col("word").isNull()).select("doc_id", "th", "n", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("len"), F.lit(None).cast("array<string>").alias("items"))
    found = hits.unionByName(lengths).groupBy("doc_id", "th").agg(
        F.max("n").alias("n"),
        F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence("start", F.col("start") + F.col("len") - 1))))).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("found"),
    )
    wanted = rows.columns if text_col in keep else [c for c in rows.columns if c != "text"]
    joined = join_rows(rows.select(*wanted, text_key()), found, hash_right=True)
    items = F.coalesce(F.array_join("found", ","), F.lit(""))
    n_items = F.coalesce(F.size("found"), F.lit(0))
    return joined.select(
        *wanted, F.col("n").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        n_items.cast("long").alias("n_items"), items.alias("items"), F.sha2(items, 256).alias("items_sha256"),
        (n_items >= min_items).alias("contaminated"),
    )
