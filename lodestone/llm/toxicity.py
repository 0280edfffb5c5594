"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its byte 2- to 5-grams (with its boundaries marked),
each an embedding in a hashed table; a passage is the average over its words; a
linear softmax over two classes reads the average.  Table and softmax are
trained jointly, in numpy, so that an unseen misspelling shares vectors with the
word it distorts; a copy of the training texts with edited words puts weight on
the n-grams that an edit leaves.  A text's score is that of its most toxic
passage: over a long text the average would drown a few words.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import binary_column, held_out, slices, texts, words_of

BUCKETS = 1 << 17
GRAMS = (2, 3, 4, 5)
DIM = 8
PASSAGE = 60
LEAST = 12  # a shorter passage is filled up with empty words


def bag_of(text: bytes | None) -> list[bytes]:
    """Words of a text, a word that follows itself taken once."""
    return [w for w, _ in groupby(words_of(text))]


def edited(words: list[bytes], rng: np.random.Generator, share: float = 0.9) -> list[bytes]:
    """The words with one random edit in about ``share`` of the longer ASCII ones:
    a character dropped, put in, replaced, or two swapped."""
    draws = rng.random((len(words), 4))
    out = []
    for w, (pick, where, kind, letter) in zip(words, draws.tolist()):
        if len(w) > 3 and w.isascii() and pick < share:
            i, c = int(where * len(w)), b"abcdefghijklmnopqrstuvwxyz0134"[int(letter * 30) :][:1]
            w = (w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :])[int(kind * 4)]
        out.append(w)
    return out


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words, one after the other, and how many each has."""
    joined = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.repeat(np.cumsum(lengths), lengths)
    word = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(joined))
    ids, owners = [], []
    for n in GRAMS:
        if len(joined) < n:
            break
        code = np.full(len(joined) - n + 1, n * 0x9E3779B1 % 2**32, np.uint32)
        for j in range(n):
            code = (code ^ joined[j : len(joined) - n + 1 + j]) * np.uint32(0x01000193)
        code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        whole = at[: len(code)] + n <= ends[: len(code)]
        ids.append((code[whole] >> np.uint32(15)).astype(np.int32))
        owners.append(word[: len(code)][whole])
    ids, owners = np.concatenate(ids), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return ids[order], np.bincount(owners, minlength=len(words))


def sums_by(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``counts`` rows."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def passages(n_words: int) -> np.ndarray:
    """Words in each passage of a text: ``PASSAGE`` each, as even as can be."""
    k = max(1, round(n_words / PASSAGE))
    return np.diff(np.linspace(0, n_words, k + 1).astype(np.int64))


@dataclass
class Softmax:
    """What scoring needs of the trained table and softmax: because both are
    linear, the margin between the classes that each bucket contributes."""

    margin: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def scorer(self, bound: int = 300_000):
        seen: dict[bytes, float] = {}

        def score(texts_of_words: list[list[bytes]]) -> np.ndarray:
            new = list({w for words in texts_of_words for w in words}.difference(seen))
            if len(seen) + len(new) > bound:
                seen.clear()
                new = list({w for words in texts_of_words for w in words})
            for at in range(0, len(new), 50_000):
                part = new[at : at + 50_000]
                ids, counts = subwords(part)
                seen.update(zip(part, (sums_by(self.margin[ids], counts) / counts).tolist()))
            out = np.empty(len(texts_of_words))
            for i, words in enumerate(texts_of_words):
                if not words:
                    out[i] = self.bias
                    continue
                runs = passages(len(words))
                means = sums_by(np.fromiter(map(seen.__getitem__, words), np.float64, len(words)), runs) / np.maximum(runs, LEAST)
                out[i] = means.max() + self.bias
            return 1 / (1 + np.exp(-np.clip(self.slope * out + self.shift, -30, 30)))

        return score


def train(words: list[list[bytes]], toxic: np.ndarray, prior: float | None = None, epochs: int = 10, steps: int = 60, seed: int = 11, rate: float = 0.05, damp: float = 1e-5, min_texts: int = 3, min_share: float = 0.01) -> Softmax:
    """Joint training of embeddings and softmax by Adam on balanced batches.

    Early epochs draw passages of either class under their text's label; later
    ones draw each text's passage that scores highest, as the score will, and
    clean passages at random.  One text in eight stays out to fit slope and
    shift of the final logit.
    """
    vocabulary = sorted({w for text in words for w in text})
    if not vocabulary or len(set(toxic.tolist())) < 2:
        share = float(np.clip(toxic.mean() if len(toxic) else 0.0, 0.01, 0.99))
        return Softmax(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    number = {w: i for i, w in enumerate(vocabulary)}
    ids, sub_counts = (np.concatenate(x) for x in zip(*(subwords(vocabulary[i : i + 20_000]) for i in range(0, len(vocabulary), 20_000))))
    sub_start = np.cumsum(sub_counts) - sub_counts
    rng = np.random.default_rng(seed)
    table, head = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, 2))
    offset = np.zeros(2)
    live = [i for i, text in enumerate(words) if text]
    aside = {i for y in (0, 1) for i in [i for i in live if toxic[i] == y][::8]}
    taught = [i for i in live if i not in aside] or live
    flat = np.concatenate([np.fromiter(map(number.__getitem__, words[i]), np.int64, len(words[i])) for i in taught])
    runs = [passages(len(words[i])) for i in taught]
    owner = np.repeat(np.array(taught), [len(r) for r in runs])
    runs = np.concatenate(runs)
    run_start = np.cumsum(runs) - runs
    label = toxic[owner]
    # Subwords of a few texts only would be learnt by heart: they stay at zero.
    words_in = np.zeros(BUCKETS, np.int64)
    for i in taught:
        own = np.fromiter({number[w] for w in words[i]}, np.int64)
        n = sub_counts[own]
        words_in[np.unique(ids[np.repeat(sub_start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())])] += 1
    common = np.flatnonzero(words_in >= max(min_texts, min_share * len(taught)))
    compact = np.full(BUCKETS, -1, np.int32)
    compact[common] = np.arange(len(common))
    ids, table = compact[ids], table[common]  # the others count in averages only
    held = np.bincount(np.repeat(np.arange(len(vocabulary)), sub_counts)[ids >= 0], minlength=len(vocabulary))
    ids, sub_start = ids[ids >= 0], np.cumsum(held) - held
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (table, head, offset)]
    step = 0
    for epoch in range(epochs):
        pools = [np.flatnonzero(label == y) for y in (0, 1)]
        if epoch >= epochs // 3:
            of_bucket = table @ (head[:, 1] - head[:, 0])
            of_word = np.concatenate([  # in pieces, to hold little at once
                sums_by(of_bucket[ids[sub_start[a] : sub_start[a] + held[a : a + 20_000].sum()]], held[a : a + 20_000]) for a in range(0, len(vocabulary), 20_000)
            ]) / sub_counts
            margin = sums_by(of_word[flat], runs) / np.maximum(runs, LEAST)
            order = np.lexsort((-margin, owner))
            top = order[np.r_[True, owner[order][1:] != owner[order][:-1]]]
            pools = [np.r_[top[label[top] == 0], rng.choice(pools[0], min(len(pools[0]), len(top)))], top[label[top] == 1]]
        if not all(map(len, pools)):
            break
        for _ in range(steps):
            part = np.concatenate([rng.choice(pool, 128) for pool in pools])
            n = runs[part]
            tokens = flat[np.repeat(run_start[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            uniq, back = np.unique(tokens, return_inverse=True)
            spans, whole = held[uniq], sub_counts[uniq][:, None]
            subs = ids[np.repeat(sub_start[uniq] - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())]
            vectors = sums_by(table[subs], spans) / whole
            slots = np.maximum(n, LEAST)[:, None]
            mean = sums_by(vectors[back], n) / slots
            logits = mean @ head + offset
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), label[part]] -= 1
            p /= len(part)
            to_word = np.repeat((p @ head.T) / slots, n, axis=0)
            word_grad = np.stack([np.bincount(back, to_word[:, d], minlength=len(uniq)) for d in range(DIM)], 1) / whole
            sub_grad = np.repeat(word_grad, spans, axis=0)
            grads = [np.stack([np.bincount(subs, sub_grad[:, d], minlength=len(common)) for d in range(DIM)], 1), mean.T @ p, p.sum(axis=0)]
            step += 1
            for value, grad, (m, v) in zip((table, head, offset), grads, state):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + damp)
    margin = np.zeros(BUCKETS)
    margin[common] = table @ (head[:, 1] - head[:, 0])
    model = Softmax(margin, float(offset[1] - offset[0]))
    return _calibrated(model, [words[i] for i in sorted(aside)], toxic[sorted(aside)], prior)


def _calibrated(model: Softmax, words: list[list[bytes]], toxic: np.ndarray, prior: float | None, cutoff: float = 0.3) -> Softmax:
    """Put the score ``cutoff`` where texts not trained on separate best: the
    middle of the gap of logits with the largest F1, clean texts weighing as in
    the corpus where ``prior`` of the labelled texts are toxic; the slope from
    the spread of the logits."""
    if len(set(toxic.tolist())) < 2:
        return model
    p = np.clip(model.scorer()(words), 1e-12, 1 - 1e-12)
    logits = np.log(p / (1 - p))
    order = np.argsort(-logits, kind="stable")
    x, y = logits[order], toxic[order]
    share = y.mean()
    each = np.where(y == 1, 1.0, 1.0 if prior is None else (1 - prior) / prior * share / (1 - share))
    hits = np.cumsum(y)
    f1 = np.where(np.r_[x[:-1] > x[1:], True], 2 * hits / (np.cumsum(each) + y.sum()), -1)
    best = int(f1.argmax())
    cut = (x[best] + x[min(best + 1, len(x) - 1)]) / 2
    slope = 4.0 / max(float(np.median(np.abs(x - cut))), 1e-3)
    return Softmax(model.margin, model.bias, slope, float(np.log(cutoff / (1 - cutoff)) - slope * cut))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train_docs: int = 2400, max_train_chars: int = 50_000) -> Softmax:
    """Learn from labelled rows that are not held out.

    At most about ``max_train_docs`` texts train, half of them toxic if there
    are enough, drawn by a hash of the id, none longer than ``max_train_chars``.
    Labels that contradict each other for one id count as toxic.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull())
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("y") > 0).cast("int").alias("y"))
    counts = dict(known.groupBy("y").count().collect())
    each = max_train_docs // 2
    draw = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1_000_000))
    share = F.when(F.col("y") == 1, F.lit(int(1e6 * each / max(1, counts.get(1, 0))) + 1)).otherwise(F.lit(int(1e6 * each / max(1, counts.get(0, 0))) + 1))
    drawn = known.filter(draw < share).limit(2 * max_train_docs)  # so small that it is broadcast
    rows = texts(docs, id_col, text_col).filter(F.col("text").isNotNull() & (F.length("text") <= max_train_chars))
    # Few fields as bytes, in a fixed order: the sample is all that the driver holds.
    sample = rows.join(F.broadcast(drawn), "doc_id").select("doc_id", F.encode("text", "utf-8").alias("text"), "y").limit(2 * max_train_docs)
    found = sorted((str(r[0]), bytes(r[1]), r[2]) for r in sample.toLocalIterator())
    labels_of = np.array([y for *_, y in found], np.int64)
    one: dict[bytes, bytes] = {}
    bags = [[one.setdefault(w, w) for w in bag_of(text)] for _, text, _ in found]
    del found
    rng = np.random.default_rng(13)
    bags += [edited(bag, rng) for bag in bags]
    return train(bags, np.concatenate([labels_of, labels_of]), counts.get(1, 0) / max(1, sum(counts.values())))


def score_toxicity(docs: DataFrame, model: Softmax, id_col: str = "doc_id", text_col: str = "text", cutoff: float = 0.3) -> DataFrame:
    """Score every whole text.

    Returns one row per input row: doc_id, held_out, score (0 to 1), predicted
    (1 if score >= ``cutoff``).  Null and wordless texts get the score of an
    average of nothing.  Repeated rows and rows with a null id each get their
    row; other columns are ignored whatever their names; an empty table gives an
    empty result; a very long text is scored whole, passage by passage.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def score(batches):
        import pyarrow as pa

        run = model.scorer()
        for batch in slices(batches):
            found = run([bag_of(t) for t in binary_column(batch, "text")])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array((found >= cutoff).astype(np.int32), pa.int32())],
                ["doc_id", "held_out", "score", "predicted"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")
