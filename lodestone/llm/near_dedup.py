"""Near-duplicate classes by improved consistent weighted sampling.

Texts are weighted sets of five-word shingles: term frequency times inverse
document frequency, that of a shingle being the mean of its words'.  (A
shingle's own document frequency is 1 almost everywhere at any size, which would
leave plain term frequency, and copies of a text would lower the weight of what
they share against that of their few edits.)  Words are counted over all
documents.  Each of ``bands * rows`` samples picks a shingle such that two texts
agree with a probability equal to their weighted Jaccard similarity; texts that
agree in all rows of a band are candidates; candidates are verified by their
exact weighted Jaccard similarity.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import binary_column, cut, join_rows, mix64, salted_join, shingle_hashes, slices, text_key, texts, words_of


class Weights:
    """Hashes and inverse document frequencies of words.

    ``keys`` are the sorted hashes of words that at least a share ``rare`` of the
    documents hold, at most mean distinct words / ``rare`` whatever the size of
    the corpus; every other word weighs as if just that share held it.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, n_docs: int, rare: float, bound: int = 400_000):
        self.keys, self.bound = keys, bound
        self.idf = np.log1p(n_docs / np.maximum(counts, 1)).astype(np.float32)
        self.most = np.float32(np.log1p(1 / rare))
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.hash, self.weight = np.zeros(1024, np.uint64), np.zeros(1024, np.float32)

    def _learn(self, new: list[bytes]) -> None:
        import xxhash

        first, last = len(self.number), len(self.number) + len(new)
        if last > len(self.hash):  # room for twice as many
            self.hash, self.weight = np.resize(self.hash, 2 * last), np.resize(self.weight, 2 * last)
        self.number.update(zip(new, range(first, last)))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))
        weights = np.full(len(new), self.most, np.float32)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            known = self.keys[at] == hashes
            weights[known] = self.idf[at[known]]
        self.hash[first:last], self.weight[first:last] = hashes, weights

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.number) > self.bound:
            self.clear()
        new = set(words).difference(self.number)
        if new:
            self._learn(list(new))
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        return self.hash[at], self.weight[at]

    def shingles(self, words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles in ascending order and their TF-IDF weights."""
        hashes, weights = self.look_up(words)
        size = min(size, len(words))
        total = np.zeros(len(words) - size + 1, np.float32)
        for j in range(size):
            total += weights[j : len(total) + j]
        found = shingle_hashes(hashes, size)
        order = np.argsort(found)
        found = found[order]
        first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else np.zeros(0, np.int64)
        tf = np.diff(np.r_[first, len(found)]).astype(np.float32)
        return found[first], tf * (total[order[first]] / np.float32(size))


def document_frequencies(rows: DataFrame, rare: float) -> Weights:
    """Counts the documents that hold each word, over all rows; the driver gets
    the words that at least a share ``rare`` of the documents hold."""

    def count(batches):
        import pyarrow as pa
        import xxhash

        seen: dict[bytes, int] = {}
        n = 0

        def out():
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, seen), np.uint64, len(seen))
            return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in slices(batches):
            for text in binary_column(batch, "text"):
                words = set(words_of(text))
                n += bool(words)
                for word in words:
                    seen[word] = seen.get(word, 0) + 1
                if len(seen) > 300_000:
                    yield out()
                    seen = {}
        yield out()
        # How many documents have words, under a null word.
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([n], pa.int64())], ["word", "n"])

    counts = cut(rows.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-frequencies")
    total = counts.filter(F.col("word").isNull()).first()
    n_docs = total["n"] if total else 0
    found = counts.filter(F.col("word").isNotNull() & (F.col("n") >= max(1.0, rare * n_docs))).toPandas()
    keys = found["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return Weights(keys[order], found["n"].to_numpy(np.int64)[order], n_docs, rare)


def _uniform(x: np.ndarray) -> np.ndarray:
    """Four independent uniforms in (0, 1) from the 16-bit parts of hashes."""
    parts = x.view(np.uint16).reshape(len(x), 4).T
    return (parts.astype(np.float32) + np.float32(0.5)) * np.float32(1 / 65536)


def sample(shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """``n`` improved consistent weighted samples (Ioffe 2010) of each text, the
    texts lying one after the other from ``starts``: the shingle and level t that
    minimise a = c exp(-r (t + 1 - beta)), with r and c of Gamma(2, 1), beta
    uniform and t = floor(ln w / r + beta).  Returns texts x samples of hashes."""
    log_w = np.log(weights)
    place = np.arange(len(shingles), dtype=np.uint64)
    out = np.empty((len(starts), n), np.uint64)
    for k in range(n):
        first = mix64(shingles + np.uint64((2 * k + 1) * 0x632BE59BD9B4E019 % 2**64))
        u = _uniform(first)
        r, c = -np.log(u[0] * u[1]), -np.log(u[2] * u[3])
        beta = (((first ^ (first >> np.uint64(31))) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(40)).astype(np.float32) * np.float32(1 / (1 << 24))
        t = np.floor(log_w / r + beta)
        # Positive floats are of the same order as their bits; the place goes below.
        bits = (c * np.exp(r * (beta - t - 1))).view(np.uint32)
        best = np.minimum.reduceat((bits.astype(np.uint64) << np.uint64(32)) | place, starts) & np.uint64(0xFFFFFFFF)
        best = best.astype(np.int64)
        out[:, k] = shingles[best] + t[best].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(out)


def signatures(rows: DataFrame, weights: Weights, size: int, bands: int, per_band: int) -> DataFrame:
    """doc_id, th, digest of the words (null without words), keys (one per band)."""
    step = np.uint64(0x9E3779B97F4A7C15)

    def keys_of(found: list) -> list:
        starts = np.r_[0, np.cumsum([len(s) for s, _ in found])[:-1]].astype(np.int64)
        picks = sample(np.concatenate([s for s, _ in found]), np.concatenate([w for _, w in found]), starts, bands * per_band)
        picks = picks.reshape(len(found), bands, per_band)
        key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(found), 1))
        for j in range(per_band):
            key = mix64(key * step + picks[:, :, j])
        return key.view(np.int64).tolist()

    def sign(batches):
        import pyarrow as pa
        import xxhash

        for batch in slices(batches):
            digests, keys, waiting, found, size_now = [], [], [], [], 0
            for i, text in enumerate(binary_column(batch, "text")):
                words = words_of(text)
                digests.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                keys.append([])
                if words:
                    found.append(weights.shingles(words, size))
                    waiting.append(i)
                    size_now += len(found[-1][0])
                if found and (size_now > 16_384 or i == batch.num_rows - 1):
                    for at, own in zip(waiting, keys_of(found)):
                        keys[at] = own
                    waiting, found, size_now = [], [], 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "th", "digest", "keys"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", text_key(), "text").mapInArrow(sign, f"doc_id {kind}, th long, digest binary, keys array<long>")


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of (a, b) with a < b: rows (node, comp), comp the
    smallest node.  Alternating large-star and small-star steps, each with its
    edges written to shared storage; only their number and the sum of their
    hashes reach the driver.  The rounds end when nothing changes any more, which
    takes about the logarithm of the nodes; ten times that is an error."""
    edges = cut(edges.distinct(), name)
    before, rounds = None, 0
    while True:
        rounds += 1
        if rounds > 400:
            raise RuntimeError("connected components do not settle")
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select(F.col("b"), F.col("a")))
        large = salted_join(large.filter(F.col("y") > F.col("x")), least.withColumnRenamed("a", "x"), "x", ["y"], 8).select(F.col("m").alias("a"), F.col("y").alias("b"))
        large = cut(large.filter(F.col("a") < F.col("b")).distinct(), name)
        lower = large.groupBy("b").agg(F.min("a").alias("m"))
        small = salted_join(large, lower, "b", ["a"], 8).select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        edges = cut(small.filter(F.col("a") < F.col("b")).distinct(), name)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("b").alias("node"), F.col("a").alias("comp"))


class Postings:
    """Shingles of a group of texts with the texts that hold them: one text's
    similarity to all others at once."""

    def __init__(self, sets: list[np.ndarray], weights: list[np.ndarray]):
        self.n, self.weights = len(sets), weights
        lengths = np.array([len(s) for s in sets])
        self.totals = np.array([w.sum(dtype=np.float64) for w in weights])
        flat, w = np.concatenate(sets), np.concatenate(weights).astype(np.float64)
        order = np.argsort(flat, kind="stable")
        self.owner, self.w = np.repeat(np.arange(self.n), lengths)[order], w[order]
        self.starts = np.flatnonzero(np.r_[True, flat[order][1:] != flat[order][:-1]])
        self.shared = np.r_[self.starts[1:], len(flat)] - self.starts
        self.place = np.empty(len(flat), np.int64)
        self.place[order] = np.repeat(np.arange(len(self.starts)), self.shared)
        self.bounds = np.r_[0, np.cumsum(lengths)]

    def held(self, i: int) -> np.ndarray:
        return self.place[self.bounds[i] : self.bounds[i + 1]]

    def similar(self, i: int, threshold: float) -> np.ndarray:
        """Texts of weighted Jaccard similarity >= threshold with text ``i``."""
        own = self.held(i)
        keep = self.shared[own] > 1
        own, mine = own[keep], self.weights[i][keep].astype(np.float64)
        if not len(own):
            return own
        spans = self.shared[own]
        at = np.repeat(self.starts[own] - np.r_[0, np.cumsum(spans)[:-1]], spans) + np.arange(spans.sum())
        both = np.bincount(self.owner[at], np.minimum(self.w[at], np.repeat(mine, spans)), minlength=self.n)
        return np.flatnonzero(both >= threshold * (self.totals[i] + self.totals - both) - 1e-9)


def link_group(ids: list, sets: list[np.ndarray], weights: list[np.ndarray], threshold: float) -> list[tuple]:
    """Classes of one candidate group under weighted Jaccard >= threshold:
    (id, class id) with the smallest id of the class.

    Central texts are compared first; then every text outside the largest class
    is compared with all, so that no link between classes is missed: such a link
    has at least one end outside the largest class.
    """
    n, postings = len(ids), Postings(sets, weights)
    root = np.arange(n)

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def compare(i):
        for j in postings.similar(i, threshold):
            a, b = find(i), find(int(j))
            if a != b:
                root[max(a, b)] = min(a, b)

    rest = range(n)
    if n > 64:
        central = np.array([postings.shared[postings.held(i)].mean() for i in range(n)])
        done = np.zeros(n, bool)
        for i in np.argsort(-central, kind="stable")[: max(16, n // 200)]:
            compare(int(i))
            done[i] = True
        roots = np.array([find(i) for i in range(n)])
        rest = np.flatnonzero((roots != np.bincount(roots, minlength=n).argmax()) & ~done)
    for i in rest:
        compare(int(i))
    return [(ids[i], ids[find(i)]) for i in range(n)]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, bands: int = 10, per_band: int = 4, rare: float = 0.001, block_bytes: int = 16 << 20) -> DataFrame:
    """Class of each document under weighted Jaccard similarity >= threshold.

    Returns one row per input row: doc_id, class_id (smallest id of the class),
    class_size (rows), is_kept (the row that stays of its class).  Texts with
    the same words are one text throughout; texts without words (null, empty)
    are each their own class, and so are rows with a null id.  Rows that repeat
    both id and text share one flag; different texts under one id are texts of
    their own.  Ids must be orderable.  Other columns are ignored whatever their
    names, an empty table gives an empty result, and a very long text is sampled
    whole.

    The keys of a band group distinct texts; a text is linked to the smallest
    of its group only, so a group of n gives n - 1 links.  Candidate components
    then meet with their shingles, in hashed blocks of about ``block_bytes``
    each.  The blocks' class representatives meet again, round by round; then
    every text outside a component's largest class visits all its blocks, which
    finds what is left: a link between two classes has an end outside the
    largest one.
    """
    rows = texts(docs, id_col, text_col)
    weights = document_frequencies(rows, rare)
    signed = cut(signatures(rows, weights, shingle, bands, per_band), "signatures")
    worded = signed.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    distinct = cut(worded.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by("th", "doc_id").alias("th"), F.min_by("keys", "doc_id").alias("keys")), "distinct-texts")
    # The digest names a text: an id can stand for several.
    banded = distinct.select("digest", F.posexplode("keys").alias("band", "key"))
    first = banded.groupBy("band", "key").agg(F.min("digest").alias("a"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    links = salted_join(banded, first, ["band", "key"], ["digest"]).filter(F.col("digest") > F.col("a")).select("a", F.col("digest").alias("b"))
    groups = components(links, "near-links")
    members = groups.union(groups.select(F.col("comp").alias("node"), "comp").distinct())
    classes = _verify(rows, distinct, members, weights, shingle, threshold, block_bytes)
    of_text = distinct.join(classes, distinct["digest"] == classes["node"], "left").select("digest", F.coalesce("cls", "digest").alias("cls"))
    of_row = salted_join(worded.select("doc_id", "th", "digest"), of_text, "digest", ["doc_id"])
    sizes = of_row.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th")).alias("first"))
    keyed = rows.select("doc_id", text_key())
    joined = join_rows(keyed, of_row.select("doc_id", "th", "cls").distinct())
    joined = salted_join(joined, sizes, "cls", ["doc_id"], how="left")
    return joined.select(
        "doc_id", "th", F.coalesce("first.doc_id", "doc_id").alias("class_id"), F.coalesce("n", F.lit(1)).alias("class_size"),
        (F.col("cls").isNull() | ((F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.th") == F.col("th")))).alias("is_kept"),
    )


def _verify(rows: DataFrame, distinct: DataFrame, members: DataFrame, weights: Weights, shingle: int, threshold: float, most: int) -> DataFrame:
    """(node, cls) for the texts of candidate components."""

    def expand(batches):
        import pyarrow as pa

        for batch in slices(batches):
            found = [weights.shingles(words_of(t), shingle) for t in binary_column(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([s.tobytes() for s, _ in found], pa.binary()), pa.array([w.tobytes() for _, w in found], pa.binary())],
                ["node", "comp", "s", "w"],
            )

    def link(key, pdf):
        pdf = pdf.sort_values("node")
        sets, weights = [np.frombuffer(s, np.uint64) for s in pdf["s"]], [np.frombuffer(w, np.float32) for w in pdf["w"]]
        found = link_group(pdf["node"].tolist(), sets, weights, threshold)
        return pd.DataFrame({"node": [a for a, _ in found], "comp": pdf["comp"].iloc[0], "cls": [b for _, b in found]})

    kind = members.schema["node"].dataType.simpleString()
    placed = members.join(distinct.select(F.col("digest").alias("node"), "rep", "th"), "node")
    once = placed.select(F.col("rep").alias("doc_id"), "th", "node", "comp")
    with_text = join_rows(rows.withColumn("th", F.xxhash64("text")), once, "inner", hash_right=True).select("node", "comp", "text")
    with_text = with_text.dropDuplicates(["node"])  # of rows that repeat both id and text
    size = F.length("s") + F.length("w")
    sets = cut(with_text.mapInArrow(expand, f"node {kind}, comp {kind}, s binary, w binary"), "near-sets")
    live, mapping, first_sizes = sets, None, None
    while True:
        sizes = cut(live.groupBy("comp").agg(F.ceil(F.sum(size) / F.lit(most)).cast("int").alias("blocks")), "near-sizes")
        first_sizes = sizes if first_sizes is None else first_sizes
        blocked = live.join(sizes, "comp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        found = cut(blocked.groupBy("comp", "block").applyInPandas(link, f"node {kind}, comp {kind}, cls {kind}"), "near-classes")
        mapping = found if mapping is None else cut(
            mapping.join(found.select(F.col("node").alias("cls"), F.col("cls").alias("up")), "cls", "left").select("node", "comp", F.coalesce("up", "cls").alias("cls")), "near-map")
        split = sizes.filter(F.col("blocks") > 1).select("comp")
        if split.isEmpty():
            break
        heads = found.filter(F.col("node") == F.col("cls")).join(split, "comp", "left_semi").select("node")
        before = live.count()
        live = cut(live.join(heads, "node", "left_semi"), "near-heads")
        if live.count() >= before:  # no class left to merge within blocks
            break
    large = first_sizes.filter(F.col("blocks") > 1)
    if large.isEmpty():
        return mapping.select("node", "cls")
    return _across_blocks(sets, mapping, large, threshold, most)


def _across_blocks(sets: DataFrame, mapping: DataFrame, large: DataFrame, threshold: float, most: int) -> DataFrame:
    """Merge classes of large components by the links between their blocks."""
    kind = mapping.schema["node"].dataType.simpleString()
    placed = sets.join(mapping.select("node", "cls"), "node").join(large, "comp").withColumn("size", F.length("s") + F.length("w"))
    counts = placed.groupBy("comp", "cls").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    largest = counts.groupBy("comp").agg(F.max_by("cls", F.struct("n", "cls")).alias("top"), F.sum("size").alias("total"), F.max_by("size", F.struct("n", "cls")).alias("held"))
    largest = largest.select("comp", "top", F.greatest(F.lit(1), F.ceil((F.col("total") - F.col("held")) / F.lit(most))).cast("int").alias("askers"))
    placed = placed.join(largest, "comp")
    own = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("askers") - 1))).withColumn("asks", F.lit(False))
    asking = placed.filter(F.col("cls") != F.col("top")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asking = asking.withColumn("turn", F.pmod(F.xxhash64("node", F.lit(1)), F.col("askers")).cast("int")).withColumn("asks", F.lit(True))
    columns = ["comp", "block", "turn", "asks", "node", "cls", "s", "w"]

    def ask(key, pdf):
        classes, edges = pdf["cls"].tolist(), set()
        askers = np.flatnonzero(pdf["asks"].to_numpy())
        if len(askers):
            postings = Postings([np.frombuffer(s, np.uint64) for s in pdf["s"]], [np.frombuffer(w, np.float32) for w in pdf["w"]])
            for i in askers:
                edges.update((min(classes[i], classes[j]), max(classes[i], classes[j])) for j in postings.similar(int(i), threshold) if classes[j] != classes[i])
        return pd.DataFrame(sorted(edges), columns=["a", "b"])

    edges = own.select(*columns).unionByName(asking.select(*columns)).groupBy("comp", "block", "turn").applyInPandas(ask, f"a {kind}, b {kind}")
    merged = components(edges, "near-across").select(F.col("node").alias("cls"), F.col("comp").alias("up"))
    return mapping.join(merged, "cls", "left").select("node", F.coalesce("up", "cls").alias("cls"))
