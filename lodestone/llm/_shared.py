"""Helpers of the corpus operators: shared storage, row keys, salting, words."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, shared_path  # noqa: F401  for the operators

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# A-Z to lower case; every other ASCII character but 0-9 and a-z to a blank.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def slices(batches, rows: int = 256):
    """Arrow batches in pieces of ``rows``: bounds what a worker unpacks at once.
    The session's own limit on bytes a batch bounds what reaches it."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def bins(spark: SparkSession) -> int:
    """How many bins spread rows by hash; follows the cluster's shuffle setting."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that operators need, under fixed names."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def text_key() -> Column:
    """With doc_id, tells rows apart that repeat an id with another text."""
    return F.xxhash64("text").alias("th")


def join_rows(left: DataFrame, right: DataFrame, how: str = "left", hash_right: bool = False) -> DataFrame:
    """Join on (doc_id, th), null-safe.  ``hash_right``: ``right`` is small in
    every partition, so it is hashed and the texts on the left are not sorted."""
    other = right.withColumnsRenamed({"doc_id": "__doc_id", "th": "__th"})
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("th") == F.col("__th"))
    joined = left.join(other.hint("shuffle_hash") if hash_right else other, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop("__doc_id", "__th")


def salted_join(big: DataFrame, small: DataFrame, key: str | list[str], spread: list[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join whose hot keys spread over ``salts`` partitions: rows of ``big``
    draw a salt from ``spread``, rows of ``small`` are repeated for each salt."""
    keys = [key] if isinstance(key, str) else key
    left = big.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case, other characters as they are.  Texts of ASCII alone
    take the faster built-in, which does the same to them."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words: runs of 0-9, a-z and non-ASCII characters."""
    return text.translate(WORD_BYTES).split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, bound: int = 400_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (splitmix64's fixed constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; a shorter text is one run."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(size, n)
    step, total = np.uint64(0x9E3779B97F4A7C15), np.zeros(n - size + 1, np.uint64)
    for j in range(size):
        total = total * step + hashes[j : n - size + 1 + j]
    return mix64(total + np.uint64(size))


def binary_column(batch, name: str) -> list:
    """A text column of an Arrow batch as UTF-8 bytes, nulls as None."""
    import pyarrow as pa

    column = batch.column(batch.schema.get_field_index(name))
    large = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if large else pa.binary()).to_pylist()
