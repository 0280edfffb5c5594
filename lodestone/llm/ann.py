"""Approximate nearest neighbours: an inverted file of coarse centroids whose
residuals are product-quantised, asymmetric distance tables, exact reranking."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import bins, cut, slices


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm from distinct rows; empty clusters keep their centre."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[: min(k, len(distinct))]].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, x[:, d], minlength=len(centres)) for d in range(x.shape[1])], 1)
        centres[n > 0] = (sums[n > 0] / n[n > 0, None]).astype(centres.dtype)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)


@dataclass
class Index:
    """Coarse centroids (lists x dims), sub-quantiser codebooks (parts x codes x
    width) and how many lists a query visits: bounded by the fit's parameters."""

    dims: int
    coarse: np.ndarray
    codebooks: np.ndarray
    probes: int

    def padded(self, x: np.ndarray) -> np.ndarray:
        parts, _, width = self.codebooks.shape
        return np.pad(x, ((0, 0), (0, parts * width - self.dims))).reshape(len(x), parts, width)

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and codes of unit vectors."""
        own = nearest(unit, self.coarse)
        split = self.padded(unit - self.coarse[own])
        codes = np.stack([nearest(split[:, j], book) for j, book in enumerate(self.codebooks)], 1)
        return own, codes.astype(np.uint8)


def fit_index(sample: np.ndarray, n_rows: int, parts: int = 16, probe_recall: float = 0.985, most_lists: int = 4096) -> Index:
    """Train on unit vectors.  About sqrt(n_rows) lists; the number of lists to
    visit is the smallest that finds ``probe_recall`` of the five true
    neighbours of sampled queries within the sample."""
    dims = sample.shape[1]
    coarse = kmeans(sample, int(min(most_lists, max(1, n_rows**0.5), len(sample))))
    own = nearest(sample, coarse)
    width = -(-dims // parts)
    index = Index(dims, coarse, np.zeros((parts, 1, width), np.float32), 1)
    split = index.padded(sample - coarse[own])
    books = [kmeans(np.ascontiguousarray(split[:, j]), 256, 8) for j in range(parts)]
    most = max(map(len, books))
    index.codebooks = np.stack([np.pad(b, ((0, most - len(b)), (0, 0)), mode="edge") for b in books])
    asked = np.linspace(0, len(sample) - 1, min(300, len(sample))).astype(int)
    cosines = sample[asked] @ sample.T
    cosines[np.arange(len(asked)), asked] = -np.inf
    k = min(5, len(sample) - 1)
    if k < 1:
        index.probes = len(coarse)
        return index
    true = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(sample[asked] @ coarse.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(place, own[true], axis=1).ravel())
    index.probes = int(min(len(coarse), needed[int(np.ceil(probe_recall * len(needed))) - 1] + 1))
    return index


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """One row per id whose vector takes part: not null, not zero, all components
    there and finite.  Of rows that repeat an id the smallest vector counts."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
        .filter(F.col("vec_id").isNotNull() & v.isNotNull())
        .filter((F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))
        .groupBy("vec_id").agg(F.min("v").alias("v"))
    )


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, each divided by a power of two so that its
    largest component lies between a half and one: no square overflows or
    vanishes, and no digit is lost."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _matrix(values, kind) -> np.ndarray:
    return np.array([np.frombuffer(v, kind) for v in values])


def nearest_neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, max_sample: int = 20_000, rerank: int = 64, rows_per_shard: int = 65_536, queries_per_block: int = 20_000) -> DataFrame:
    """For each row whose id is divisible by ``every`` the ``k`` other rows with
    the largest cosine found; ties to the smaller id.

    Returns query_id, rank (from 1), vec_id, score: the cosine in double
    precision on the original vectors.  Fewer than ``k`` other rows give all of
    them.  Vectors that are null, zero or have null or non-finite components, or
    another dimension than most of the sample, take no part.  Of rows that repeat
    an id the smallest vector counts, rows with a null id take no part, other
    columns are ignored whatever their names, and an empty table gives an empty
    result.  Vectors may be long; a row's memory is that of its vector.

    The fit sees at most about ``max_sample`` vectors, drawn by a hash of the
    id; every row is indexed.  Rows are dealt to shards by a hash of the id, so
    equal vectors or a crowded list spread evenly; each shard holds its part of
    every list.  Queries visit the shards in blocks.  In each shard a query visits
    ``index.probes`` lists, and the next nearest ones as long as they hold fewer
    than ``k`` candidates, so that no query gets fewer than there are.  A shard
    returns its ``k`` best after reranking ``rerank`` candidates exactly.
    """
    spark = vectors.sparkSession
    rows = cut(usable(vectors, id_col, vector_col), "vectors")
    n = rows.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    draw = F.pmod(F.xxhash64(F.lit(9), "vec_id"), F.lit(1_000_000))
    drawn = rows.filter(draw < int(1e6 * max_sample / n) + 1).orderBy("vec_id").limit(2 * max_sample)
    if drawn.isEmpty():
        drawn = rows.limit(max_sample)
    sample = [np.array(r["v"], np.float64) for r in drawn.select("v").toLocalIterator()]
    sizes = [len(v) for v in sample]
    dims = max(set(sizes), key=lambda d: (sizes.count(d), -d))
    index = fit_index(unit_rows(np.array([v for v in sample if len(v) == dims])), n)
    exact = np.float32 if rows.schema["v"].dataType.elementType.simpleString() == "float" else np.float64

    def encode(batches):
        import pyarrow as pa

        for batch in slices(batches, 4096):
            x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), exact).reshape(batch.num_rows, dims)
            lists, codes = index.encode(unit_rows(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lists, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())],
                ["vec_id", "list", "codes", "v"],
            )

    def search(key, left, right):
        found = []
        if len(left) and len(right):
            left = left.sort_values(["list", "vec_id"])
            ids, lists, codes = left["vec_id"].to_numpy(), left["list"].to_numpy(), np.ascontiguousarray(_matrix(left["codes"], np.uint8).T)
            x = _matrix(left["v"], exact)
            starts, ends = np.searchsorted(lists, np.arange(len(index.coarse))), np.searchsorted(lists, np.arange(len(index.coarse)), side="right")
            parts = np.arange(len(codes))[:, None]
            for query, v in zip(right["vec_id"], right["v"]):
                q = scaled(np.frombuffer(v, exact)[None])[0]
                size = np.sqrt((q**2).sum())
                near = (q / size).astype(np.float32)
                coarse = index.coarse @ near
                visited = np.argsort(-coarse, kind="stable")
                enough = np.searchsorted(np.cumsum((ends - starts)[visited]), k + 1) + 1  # the query itself may be one
                visited = visited[: max(index.probes, int(enough))]
                at = np.concatenate([np.arange(starts[j], ends[j]) for j in visited])
                at = at[ids[at] != query]
                if not len(at):
                    continue
                tables = np.einsum("pcw,pw->pc", index.codebooks, index.padded(near[None])[0])
                guess = coarse[lists[at]] + tables[parts, codes[:, at]].sum(axis=0)
                best = at[np.lexsort((ids[at], -guess))[:rerank]]
                exactly = scaled(x[best])
                score = (exactly @ q) / (np.sqrt((exactly**2).sum(axis=1)) * size)
                top = np.lexsort((ids[best], -score))[:k]
                found += [(query, int(ids[best[t]]), float(score[t])) for t in top]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    shards = max(-(-n // rows_per_shard), min(bins(spark), -(-n // 4096)))
    blocks = max(1, -(-(n // every + 1) // queries_per_block))
    coded = rows.filter(F.size("v") == dims).mapInArrow(encode, "vec_id long, list int, codes binary, v binary")
    left = coded.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = coded.filter(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    right = right.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
