"""Substring dedup by a compressed FM-index per shard.

Every window of ``window`` words has a minimiser: the smallest hash among its
runs of ``SEED`` words.  Equal windows have equal minimisers, so windows whose
minimiser stands in one document only can repeat nowhere and stay behind.  The
others form segments: the words of a document around windows in a row that share
a minimiser.  The distinct segments, each with the smallest document that holds
it, go to the shard that their minimiser names and are indexed there: suffix
order, Burrows-Wheeler transform, a wavelet matrix of packed bits for rank.  They
are then streamed against the index by backward search; wherever a match is as
long as a window, its suffix interval gives the smallest document that holds it,
and the interval is reported for every larger document of the segment.

Shards hold about ``shard_words`` words.  A minimiser with more than
``crowd_words`` words in distinct segments (a passage that very many documents
share, each going on differently) would crowd one.  Its windows are compared by
their own hashes instead: the exact way for the rest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import WordHashes, binary_column, cut, join_rows, mix64, salted_join, shingle_hashes, slices, text_key, texts

SEED = 8


class Bits:
    """A packed bit vector with the set bits before each packed word: 1.5 bits a bit."""

    def __init__(self, bit: np.ndarray):
        packed = np.packbits(bit, bitorder="little")
        self.packed = np.pad(packed, (0, -len(packed) % 8 + 8)).view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.packed), dtype=np.int64)].astype(np.uint32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).view(np.uint64)) - np.uint64(1)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.packed[word] & mask)


class WaveletMatrix:
    """Rank over integers below 2**levels: one packed bit vector per level."""

    def __init__(self, values: np.ndarray, levels: int, symbols: int):
        self.levels, self.bits, self.zeros = levels, [], []
        for level in range(levels - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            self.bits.append(Bits(bit))
            self.zeros.append(int(len(values) - bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])
        # Where a symbol's values begin on the last level: the same for all ranks.
        self.first = self._descend(np.arange(symbols), np.zeros(symbols, np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i in range(self.levels):
            ones = self.bits[i].rank(at)
            at = np.where((symbols >> (self.levels - 1 - i)) & 1, self.zeros[i] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        return self._descend(symbols, at) - self.first[symbols]


class FMIndex:
    """Index of word segments, each with a number; smaller numbers come first.

    What stays is packed: the wavelet matrix of the transform, the places where
    suffixes begin to differ within ``window`` - 1 and ``window`` words, and for
    the latter's classes the smallest number among them.
    """

    def __init__(self, segments: list[np.ndarray], numbers: np.ndarray, window: int):
        lengths = np.array([len(s) for s in segments])
        flat = np.concatenate(segments)
        self.alphabet = np.unique(flat)
        symbols = len(self.alphabet) + 1
        n = self.n = len(flat) + len(segments)
        self.window = window
        text = np.zeros(n, np.int64)  # each segment ends with a 0
        starts = np.cumsum(lengths + 1) - lengths - 1
        text[np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(len(flat))] = self.number_of(flat)
        # Suffix order by doubling: after step h suffixes are ordered by 2h words,
        # which is as long as any segment when the steps end.
        rank, h, kept = text, 1, {1: text}
        while True:
            follow = np.full(n, -1, np.int64)
            follow[: n - h] = rank[h:]
            key = rank * (n + 2) + follow + 1
            order = np.argsort(key)
            sorted_key = key[order]
            fresh = np.cumsum(np.r_[0, sorted_key[1:] != sorted_key[:-1]])
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            h *= 2
            if h < window:
                kept[h] = rank
            if h > lengths.max() or fresh[-1] == n - 1:
                break
        short, long = (self._borders(kept, order, depth) for depth in (window - 1, window))
        self.short, self.long = Bits(short), Bits(long)
        self.class_starts = np.r_[np.flatnonzero(short), n].astype(np.uint32)
        self.least = np.minimum.reduceat(np.repeat(numbers, lengths + 1)[order], np.flatnonzero(long)).astype(np.int32)
        self.wavelet = WaveletMatrix(text[order - 1], max(1, symbols.bit_length()), symbols)
        counts = np.bincount(text, minlength=symbols)
        self.before = np.cumsum(counts) - counts

    def number_of(self, words: np.ndarray) -> np.ndarray:
        """Symbols of words that the index holds."""
        return np.searchsorted(self.alphabet, words) + 1

    @staticmethod
    def _borders(kept: dict[int, np.ndarray], order: np.ndarray, depth: int) -> np.ndarray:
        """Whether a suffix differs from the one before within ``depth`` words."""
        h = max(k for k in kept if k <= max(depth, 1))
        a, far = kept[h][order], order + depth - h
        inside = (far >= 0) & (far < len(order))
        shifted = np.full(len(order), -1, np.int64)
        shifted[inside] = kept[h][far[inside]]
        return np.r_[True, (a[1:] != a[:-1]) | (shifted[1:] != shifted[:-1])]

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: intervals of the matches lengthened to the left."""
        ranks = self.wavelet.rank(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        return self.before[symbols] + ranks[: len(low)], self.before[symbols] + ranks[len(low) :]

    def matches(self, segments: list[np.ndarray], at_once: int = 200_000) -> np.ndarray:
        """For every window of the segments, one after the other, the smallest
        number among the indexed segments that hold it."""
        w = self.window
        lengths = np.array([len(s) for s in segments])
        flat = self.number_of(np.concatenate(segments))
        starts = np.cumsum(lengths) - lengths
        windows = lengths - w + 1
        base = np.cumsum(windows) - windows
        out = np.empty(windows.sum(), np.int32)
        for first in range(0, len(segments), at_once):
            live = np.arange(first, min(first + at_once, len(segments)))
            low, high = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
            place, depth = lengths[live] - 1, 0
            while len(live):
                low, high = self.extend(flat[starts[live] + place], low, high)
                depth += 1
                if depth >= w:
                    out[base[live] + place] = self.least[self.long.rank(low + 1) - 1]
                    # Shorten the match to window - 1 words: its class in the suffix order.
                    own = self.short.rank(low + 1)
                    low, high = self.class_starts[own - 1].astype(np.int64), self.class_starts[own].astype(np.int64)
                place = place - 1
                on = place >= 0
                if not on.all():
                    live, low, high, place = live[on], low[on], high[on], place[on]
        return out


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every run of ``size`` values, by doubling."""
    step, out = 1, x
    while step * 2 <= size:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = size - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def minimiser_runs(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, past the last window) of each run of windows
    that share a minimiser."""
    if len(hashes) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    seed = min(SEED, window)
    least = sliding_min(shingle_hashes(hashes, seed), window - seed + 1)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    return least[first], first, np.r_[first[1:], len(least)]


class RunHashes:
    """Two 64-bit hashes of any run of words, from sums of hashes times powers."""

    STEP = np.uint64(0x9E3779B97F4A7C15)
    BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def of(self, hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= len(hashes):
            n = 2 * len(hashes)
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(n, x)]) for x in (self.STEP, self.BACK))
        out = []
        for words in (hashes, mix64(hashes ^ np.uint64(0xA0761D6478BD642F))):
            sums = np.r_[np.uint64(0), np.cumsum(words * self.up[: len(words)])]
            out.append(mix64((sums[last] - sums[first]) * self.down[first] + (last - first).astype(np.uint64)))
        return out[0], out[1]


def window_hashes(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    return shingle_hashes(hashes, window), shingle_hashes(mix64(hashes ^ np.uint64(0xA0761D6478BD642F)), window)


def ranges_of(least: np.ndarray, segment: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last place of each run of wanted windows of one segment
    with one smallest document."""
    new = np.r_[True, (least[1:] != least[:-1]) | (segment[1:] != segment[:-1]) | (wanted[1:] != wanted[:-1])]
    starts = np.flatnonzero(new)
    ends = np.r_[starts[1:], len(least)]
    keep = wanted[starts]
    return starts[keep], ends[keep]


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, shard_words: int = 500_000, crowd_words: int = 1_000_000) -> DataFrame:
    """Documents without the words that an earlier document has in the same run.

    A word goes if a window of ``window`` consecutive words covers it whose
    words also start, in this order, in a document with a smaller id.

    Returns one row per input row: doc_id, n_words, n_removed, kept (the other
    words joined by one blank).  Words are runs of other characters than blank
    and \\t to \\r.  A null text has no words; a null id is no smaller than any
    and never loses words; rows repeating an id do not affect each other.  Other
    columns are ignored whatever their names, an empty table gives an empty
    result, and a very long text is as many segments as it needs.
    """
    rows = texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    keyed = rows.select("doc_id", text_key(), "text")

    def find_runs(batches):
        import pyarrow as pa

        hashes, run_hashes = WordHashes(), RunHashes()
        for batch in slices(batches):
            out = [[] for _ in range(6)]
            for i, text in enumerate(binary_column(batch, "text")):
                words = hashes.of(text.split()) if text else np.zeros(0, np.uint64)
                least, a, z = minimiser_runs(words, window)
                if len(a):
                    for column, values in zip(out, (np.full(len(a), i), least, a, z, *run_hashes.of(words, a, z + window - 1))):
                        column.append(values)
            at, m, a, z, h1, h2 = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(m.view(np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                 pa.array(a.astype(np.int32)), pa.array(z.astype(np.int32))],
                ["doc_id", "th", "m", "h1", "h2", "first", "last"],
            )

    runs = keyed.filter(F.col("doc_id").isNotNull()).mapInArrow(find_runs, f"doc_id {kind}, th long, m long, h1 long, h2 long, first int, last int")
    runs = cut(runs, "runs")
    shared = runs.groupBy("m").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).filter(F.col("a") < F.col("z")).select("m")
    suspects = cut(salted_join(runs, shared, "m", ["doc_id", "first"]), "suspect-runs")
    segment = ["m", "h1", "h2"]
    held = cut(suspects.groupBy(*segment).agg(F.min(F.struct("doc_id", "th", "first", "last")).alias("at"), F.max("doc_id").alias("z")), "distinct-segments")
    n_words = F.sum(F.col("at.last") - F.col("at.first") + (window - 1))
    crowded = held.groupBy("m").agg(n_words.alias("n")).filter(F.col("n") > crowd_words).select("m", F.lit(True).alias("crowded"))
    total = held.agg(n_words).first()[0] or 0
    reps = salted_join(held, crowded, "m", ["h1"], how="left").select("at.doc_id", "at.th", F.struct(*segment, "z", "at.first", "at.last", F.coalesce("crowded", F.lit(False)).alias("crowded")).alias("s"))
    wanted = reps.groupBy("doc_id", "th").agg(F.collect_list("s").alias("segments"))

    def fetch(batches):
        import pyarrow as pa

        hashes = WordHashes()
        for batch in slices(batches, 64):
            at, out = [], {name: [] for name in ("m", "h1", "h2", "z", "off", "w1", "w2", "words")}
            for i, (text, own) in enumerate(zip(binary_column(batch, "text"), batch.column(3).to_pylist())):
                found = hashes.of(text.split())
                for s in own:
                    words = found[s["first"] : s["last"] + window - 1]
                    w1, w2 = (x.view(np.int64).tolist() for x in window_hashes(words, window)) if s["crowded"] else ([None], [None])
                    n = len(w1)
                    at += [i] * n
                    for name in ("m", "h1", "h2", "z"):
                        out[name] += [s[name]] * n
                    out["off"] += range(n)
                    out["w1"] += w1
                    out["w2"] += w2
                    out["words"] += [None] * n if s["crowded"] else [words.tobytes()]
            kinds = {"off": pa.int32(), "words": pa.binary(), "z": batch.column(0).type}
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()]], ["a", *out])

    with_text = join_rows(keyed, wanted, "inner", hash_right=True).select("doc_id", "th", "text", "segments")
    parts = cut(with_text.mapInArrow(fetch, f"a {kind}, m long, h1 long, h2 long, z {kind}, off int, w1 long, w2 long, words binary")
                .dropDuplicates([*segment, "off"]), "segments")  # of rows that repeat both id and text

    def search(key, pdf):
        held = [np.frombuffer(w, np.uint64) for w in pdf["words"]]
        documents, number = np.unique(pdf["a"].to_numpy(), return_inverse=True)
        least = FMIndex(held, number, window).matches(held)
        windows = np.array([len(s) for s in held]) - window + 1
        of = np.repeat(np.arange(len(held)), windows)
        starts, ends = ranges_of(least, of, documents[least] < pdf["z"].to_numpy()[of])
        base, own = np.cumsum(windows) - windows, of[starts]
        return pd.DataFrame({**{c: pdf[c].to_numpy()[own] for c in segment}, "least": documents[least[starts]], "from": starts - base[own], "to": ends - base[own]})

    shards = int(total // shard_words) + 1
    cool = parts.filter(F.col("words").isNotNull()).withColumn("shard", F.pmod(F.xxhash64("m"), F.lit(shards)).cast("int"))
    by_index = cool.select("shard", *segment, "a", "z", "words").groupBy("shard").applyInPandas(search, f"m long, h1 long, h2 long, least {kind}, `from` int, `to` int")
    hot = parts.filter(F.col("words").isNull()).select(*segment, "a", "z", "off", "w1", "w2")
    first = hot.groupBy("w1", "w2").agg(F.min("a").alias("least"), F.max("z").alias("most")).filter(F.col("least") < F.col("most")).select("w1", "w2", "least")
    by_hash = salted_join(hot, first, ["w1", "w2"], ["h1", "off"]).filter(F.col("z") > F.col("least")).select(
        *segment, "least", F.col("off").alias("from"), (F.col("off") + 1).alias("to"))
    ranges = by_index.unionByName(by_hash).groupBy(*segment).agg(F.collect_set(F.struct("least", "from", "to")).alias("ranges"))
    spans = salted_join(suspects, ranges, segment, ["doc_id", "first"]).select("doc_id", "th", "first", F.explode("ranges").alias("r")).filter(F.col("doc_id") > F.col("r.least"))
    gone = spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct((F.col("first") + F.col("r.from")).alias("from"), (F.col("first") + F.col("r.to") + (window - 1)).alias("to"))).alias("gone"))

    def remove(batches):
        import pyarrow as pa

        for batch in slices(batches, 256):
            n_words, n_removed, kept = [], [], []
            for text, spans_of in zip(binary_column(batch, "text"), batch.column(2).to_pylist()):
                words = text.split() if text else []
                mask = None
                for span in spans_of or ():
                    mask = mask or bytearray(len(words))
                    mask[span["from"] : span["to"]] = b"\1" * (span["to"] - span["from"])
                stay = [w for w, m in zip(words, mask) if not m] if mask else words
                n_words.append(len(words))
                n_removed.append(len(words) - len(stay))
                kept.append(b" ".join(stay))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    joined = join_rows(keyed, gone, hash_right=True).select("doc_id", "text", "gone")
    return joined.mapInArrow(remove, f"doc_id {kind}, n_words long, n_removed long, kept string")
