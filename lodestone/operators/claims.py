"""Sentence, claim and chunk operators whose decisions run along a text.

What depends on the piece before it (sentence boundaries, packing, restated
sentences, line grammars) runs per row in Arrow batches; nothing gathers rows.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType

# Abbreviations that do not end a sentence.
ABBREVIATIONS = {"dr", "mr", "mrs", "ms", "prof", "st", "vs", "etc", "e.g", "i.e", "no", "fig", "approx"}
BOUNDARY = re.compile(r"(?<=[.!?])[\"')\]]*\s+(?=[\"'(\[]?[A-Z0-9À-Þ])")


def sentences_of(text: str) -> list[str]:
    """Sentences: a mark, blanks, then a capital or digit; not after an
    abbreviation or an initial."""
    out, start = [], 0
    for m in BOUNDARY.finditer(text):
        last = text[start : m.start()].rstrip("\"')]").rsplit(None, 1)[-1:] or [""]
        word = last[0].rstrip(".!?").lower().lstrip("(\"'[")
        if last[0].endswith(".") and (word in ABBREVIATIONS or (len(word) == 1 and word.isalpha())):
            continue
        out.append(text[start : m.end()].strip())
        start = m.end()
    out.append(text[start:].strip())
    return [s for s in out if s]


def restated(sentences: list[str], threshold: float = 0.72, least: int = 6) -> list[bool]:
    """Which sentences repeat the content of an earlier one that stays."""
    kept: list[set] = []
    flags = []
    for s in sentences:
        words = {w for w in re.findall(r"[a-z0-9]{4,}", s.lower())}
        hit = len(words) >= least and any(len(k) >= least and len(words & k) >= threshold * min(len(words), len(k)) for k in kept)
        flags.append(hit)
        if not hit:
            kept.append(words)
    return flags


def pack(text: str, most: int = 2400, tail: int = 350) -> list[str]:
    """Chunks of lines up to ``most`` characters; each begins with whole lines
    or words from the end of the one before, up to ``tail`` characters."""
    chunks, held, fresh = [], "", False
    for line in text.split("\n"):
        while len(line) > most:
            cut = line.rfind(" ", 1, most)
            cut = cut if cut > 0 else most
            head, line = line[:cut], line[cut:].lstrip(" ")
            if fresh:
                chunks.append(held)
            chunks.append(head)
            held, fresh = head[-tail:].split(" ", 1)[-1], False
        if fresh and len(held) + 1 + len(line) > most:
            chunks.append(held)
            overlap = held[-tail:]
            at = overlap.find("\n")
            held, fresh = (overlap[at + 1 :] if at >= 0 else overlap.split(" ", 1)[-1]), False
            if len(held) + 1 + len(line) > most:
                held = ""
        held = f"{held}\n{line}" if held else line
        fresh = True
    if fresh and held.strip():
        chunks.append(held)
    return chunks


def sentence_rows(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """One row per sentence: the key columns, pos, sentence, restates."""
    schema = rows.select(*key).schema.add("pos", IntegerType()).add("sentence", StringType()).add("restates", BooleanType())

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                found = sentences_of(getattr(row, text) or "")
                out += [(*[getattr(row, k) for k in key], i, s, r) for i, (s, r) in enumerate(zip(found, restated(found)))]
            yield pd.DataFrame(out, columns=[*key, "pos", "sentence", "restates"])

    return rows.select(*key, text).mapInPandas(run, schema)


def chunk_rows(rows: DataFrame, key: str, text: str, most: int = 2400, tail: int = 350) -> DataFrame:
    """One row per chunk: key, pos, chunk."""
    schema = rows.select(key).schema.add("pos", IntegerType()).add("chunk", StringType())

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(k, i, c) for k, t in zip(pdf[key], pdf[text]) for i, c in enumerate(pack(t or "", most, tail))], columns=[key, "pos", "chunk"])

    return rows.select(key, text).mapInPandas(run, schema)


def normalise_nfkc(text: Column) -> Column:
    """Unicode NFKC, which no built-in offers."""

    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return nfkc(text)


INVISIBLE = "[\\p{Cf}\\p{Cc}&&[^\\t\\n\\r\\f\\x0B]]"


def strip_invisible(text: Column) -> Column:
    """Format and control characters dropped, blanks and line ends kept."""
    return F.regexp_replace(text, INVISIBLE, "")


def hashed_words(text: Column, dims: int = 64) -> Column:
    """Deterministic bag-of-words embedding: signed hashed counts, length one."""

    @F.pandas_udf("array<float>")
    def embed(s: pd.Series) -> pd.Series:
        import numpy as np
        import xxhash

        def one(t):
            v = np.zeros(dims, np.float64)
            for w in re.findall(r"[a-z0-9]+", (t or "").lower()):
                h = xxhash.xxh3_64_intdigest(w)
                v[h % dims] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            return (v / n if n else v).astype(np.float32).tolist()

        return s.map(one)

    return embed(text)
