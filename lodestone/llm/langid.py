"""Language identification by nearest centroid.

Texts become hashed TF-IDF vectors of byte 1- to 3-grams, normalised to length
one.  Each language has several centroids (spherical k-means over its training
vectors); a text takes the language of the centroid with the largest cosine, and
is rejected where even that one lies further away than training texts cut to its
length do: short texts lie far from every centroid, long ones near to theirs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import WORD_BYTES, binary_column, held_out, slices, texts

FEATURES = 4096
UNKNOWN = "und"


def features(text: bytes) -> np.ndarray:
    """Sublinear counts of the hashed byte 1- to 3-grams of a whole text, other
    characters than letters, digits and non-ASCII ones taken as one blank."""
    joined = b" " + b" ".join(text.translate(WORD_BYTES).split()) + b" "
    counts = np.zeros(FEATURES, np.float32)
    for at in range(0, len(joined), 1 << 20):  # bounded memory for very long texts
        part = np.frombuffer(joined, np.uint8)[at : at + (1 << 20) + 2].astype(np.uint32)
        for n in (1, 2, 3):
            if len(part) >= n:
                code = np.full(len(part) - n + 1, n * 0x1F1F1F1F, np.uint32)
                for j in range(n):
                    code = code * np.uint32(0x01000193) + part[j : len(part) - n + 1 + j]
                code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                counts += np.bincount((code >> np.uint32(20)), minlength=FEATURES)
    return np.log1p(counts)


@dataclass
class Centroids:
    """A fitted model: at most languages x centroids vectors of 4096 floats, and
    for each language the least cosine by ``length_class``."""

    langs: list[str]
    vectors: np.ndarray
    lang_of: np.ndarray
    idf: np.ndarray
    floor: np.ndarray

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest centroid and the cosine, for rows of counts."""
        weighted = counts * self.idf
        norms = np.linalg.norm(weighted, axis=1, keepdims=True)
        cosines = (weighted / np.where(norms > 0, norms, 1)) @ self.vectors.T
        best = cosines.argmax(axis=1)
        return best, cosines[np.arange(len(best)), best]


CLASSES = range(3, 13)


def length_class(n_bytes: int) -> int:
    """Index of the power of two in ``CLASSES`` that a text's length reaches."""
    return min(max(n_bytes.bit_length() - 1, CLASSES[0]), CLASSES[-1]) - CLASSES[0]


def _cluster(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from evenly spaced rows; empty clusters go."""
    centres = rows[np.linspace(0, len(rows) - 1, min(k, len(rows))).astype(int)]
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(axis=1)
        sums = [rows[own == j].sum(axis=0) for j in range(len(centres)) if (own == j).any()]
        centres = np.array([s / max(np.linalg.norm(s), 1e-12) for s in sums], np.float32)
    return centres


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", centroids: int = 4, max_train_docs: int = 4000, max_langs: int = 200, reject: float = 0.9) -> Centroids | None:
    """Learn from labelled rows that are not held out.

    The ``max_langs`` most frequent labels are learned (ties by name).  At most
    about ``max_train_docs`` rows train, an equal bound for each language, 20 at
    least, drawn by a hash of the id.  A language's rejection floor for a length
    is ``reject`` times the 0.1% quantile of the cosines of its training texts
    cut to that length.  Repeated rows count as often as they stand there; null
    ids, texts and labels teach nothing.  None if nothing is labelled.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = [(r[0], r[1]) for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()]
    if not counts:
        return None
    each = max(20, max_train_docs // len(counts))
    draw = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1_000_000))
    share = F.create_map(*[x for lang, n in counts for x in (F.lit(lang), F.lit(min(1_000_000, int(1_000_000 * each / n) + 1)))])
    drawn = rows.filter(draw < share[F.col("lang")]).select("text", "lang")
    most = 2 * max(max_train_docs, 20 * len(counts))

    def vectors(batches):
        import pyarrow as pa

        for batch in slices(batches):
            found = [features(t).astype(np.float16).tobytes() for t in binary_column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.binary())], ["lang", "v"])

    sample = drawn.mapInArrow(vectors, "lang string, v binary").limit(most).toPandas().sort_values(["lang", "v"])
    x = np.array([np.frombuffer(v, np.float16) for v in sample["v"]], np.float32)
    lang = sample["lang"].to_numpy()
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    x = x * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    langs, found, owner = sorted(set(lang)), [], []
    for i, name in enumerate(langs):
        centres = _cluster(x[lang == name], centroids)
        found.append(centres)
        owner += [i] * len(centres)
    model = Centroids(langs, np.concatenate(found).astype(np.float32), np.array(owner), idf, np.zeros((len(langs), len(CLASSES))))

    def cosines(batches):
        import pyarrow as pa

        number = {name: i for i, name in enumerate(model.langs)}
        for batch in slices(batches):
            out = []
            for text, name in zip(binary_column(batch, "text"), batch.column(1).to_pylist()):
                own = model.vectors[model.lang_of == number.get(name, -1)]
                for c in range(length_class(len(text)) + 1 if len(own) else 0):
                    v = features(text[: 1 << CLASSES[c]]) * model.idf
                    out.append((number[name], c, float((own @ v).max() / max(np.linalg.norm(v), 1e-12))))
            yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*out) if out else ([], [], []), (pa.int32(), pa.int32(), pa.float64()))], ["lang", "c", "cosine"])

    near = drawn.mapInArrow(cosines, "lang int, c int, cosine double").groupBy("lang", "c").agg(F.sort_array(F.collect_list("cosine")).alias("x")).collect()
    for r in sorted(near, key=lambda r: (r["lang"], r["c"])):
        model.floor[r["lang"], r["c"] :] = reject * float(np.quantile(r["x"], 0.001))
    return model


LETTER = re.compile(r"[^\W\d_]")


def identify(docs: DataFrame, model: Centroids | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Predict the language of every whole text.

    Returns one row per input row: doc_id, held_out, lang_pred (a learned
    language; ``und`` if the text is null or has no letter, or nothing was
    learned), score (cosine to the nearest centroid, 0 to 1), rejected (``und``,
    or further away than the language's floor for the text's length), and the
    columns ``keep``.  Repeated rows and rows with a null id each get their row;
    other columns are ignored whatever their names; an empty table gives an empty
    result; a very long text counts whole, in pieces of a megabyte.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"),
        *[F.col(c) for c in keep if c not in (id_col, text_col)],
    )

    def predict(batches):
        import pyarrow as pa

        for batch in slices(batches):
            raw = binary_column(batch, "text")
            lang, score, rejected = [UNKNOWN] * len(raw), np.zeros(len(raw)), np.ones(len(raw), bool)
            live = [i for i, t in enumerate(raw) if model is not None and t and LETTER.search(t.decode("utf-8", "replace"))]
            if live:
                best, cosine = model.nearest(np.array([features(raw[i]) for i in live]))
                for i, b, c in zip(live, best, cosine):
                    lang[i], score[i], rejected[i] = model.langs[model.lang_of[b]], min(max(float(c), 0.0), 1.0), c < model.floor[model.lang_of[b], length_class(len(raw[i]))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                [*batch.schema.names, "lang_pred", "score", "rejected"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    found = rows.mapInArrow(predict, f"{fields}, lang_pred string, score double, rejected boolean")
    return found if text_col in keep else found.drop("text")
