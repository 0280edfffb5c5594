"""License scans by an exact set-similarity join, in DataFrame operations only.

A template is a set of words; a block is any run of words of a text, wherever
its lines end, that is as long as the template divided by the threshold.  Words
get one global order, from rare to frequent over all texts.  A block can contain
``threshold`` of a template only if it holds one of the template's
n - ceil(threshold * n) + 1 rarest words (prefix); its text must have at least
ceil(threshold * n) words (length); and the block must lie inside the text with
that word inside the block (position).  What passes is verified block by block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import join_rows, lower_ascii, texts

# Base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Sentences of well-known public license notices, as lower-case words.
TEMPLATES = (
    ("agpl-3.0", "it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("artistic-2.0", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed artistic"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
)
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def padded(text: Column) -> Column:
    """Words with one blank before, between and after them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_ascii(text), GAPS, " ")), F.lit(" "))


def blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def base_phrases(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text) to word counts and the places of the base phrases.

    Splitting the padded words at a phrase gives the pieces around its places:
    their blanks count the words before the first and after the last."""
    norm = docs.select("doc_id", "th", padded(F.coalesce("text", F.lit(""))).alias("norm"))
    out = norm.withColumn("n_words", F.when(F.col("norm") == "  ", 0).otherwise(blanks(F.col("norm")) - 1).cast("long"))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES:
        name = label.replace("-", "_")
        pieces = F.split("norm", f"(?<= ){phrase}(?= )", -1)
        out = out.withColumn(name, F.when(F.col("norm").contains(f" {phrase} "), F.struct(
            (F.size(pieces) - 1).alias("n"), (blanks(F.element_at(pieces, 1)) - 1).alias("first"),
            (F.col("n_words") - (blanks(F.element_at(pieces, -1)) - 1) - len(phrase.split())).alias("last"),
        )))
        counts.append(F.coalesce(F.col(f"{name}.n"), F.lit(0)))
        firsts.append(F.col(f"{name}.first"))
        lasts.append(F.col(f"{name}.last"))
        labels.append(F.when(F.col(name).isNotNull(), F.lit(label)))
    return out.select(
        "doc_id", "th", "n_words", sum(counts[1:], counts[0]).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base"),
    )


def plan_of(templates, threshold: float) -> list[tuple]:
    """(number, label, distinct words, words needed, words of a block)."""
    out = []
    for no, (label, words) in enumerate(templates):
        split = words.split()
        inside = sorted(set(split))
        out.append((no, label, inside, math.ceil(threshold * len(inside) - 1e-9), math.ceil(len(split) / threshold - 1e-9)))
    return out


def template_blocks(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.85) -> DataFrame:
    """(doc_id, th, text) to matches: doc_id, th, label, no and containment, the
    largest of any block, for every template that some block contains."""
    plan = plan_of(templates, threshold)
    vocabulary = sorted({w for _, _, inside, _, _ in plan for w in inside})
    longest = max(width for *_, width in plan)
    split = docs.select("doc_id", "th", F.split(F.trim(padded(F.col("text"))), " ").alias("words"))
    # At most one row for each word of the templates, which stand in the code.
    held = split.select(F.explode(F.array_intersect(_words(vocabulary), F.col("words"))).alias("word"))
    seen = dict(held.groupBy("word").count().collect())
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (seen.get(w, 0), w)))}
    rows = []
    for no, label, inside, need, width in plan:
        ordered = sorted(inside, key=rank.get)
        rows += [(no, label, ordered, need, width, word) for word in ordered[: len(ordered) - need + 1] if word in seen]
    prefix = docs.sparkSession.createDataFrame(rows, "no int, label string, template array<string>, need int, width int, word string")
    rare = sorted({r[-1] for r in rows}) or [""]
    places = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: x["word"].isin(rare))
    found = (
        split.filter(F.arrays_overlap("words", _words(rare)))
        .select("doc_id", "th", "words", F.size("words").alias("n"), F.explode(places).alias("p"))
        # Only the words around the place travel on.
        .select("doc_id", "th", "n", "p.word", F.least("p.at", F.lit(longest - 1)).alias("before"),
                F.slice("words", F.greatest(F.col("p.at") - (longest - 2), F.lit(1)), F.least(F.col("p.at") + 1, F.lit(longest)) + (longest - 1)).alias("around"))
        .join(F.broadcast(prefix), "word")
        .filter(F.col("n") >= F.col("need"))
        .filter(F.size(F.array_intersect("template", "around")) >= F.col("need"))
        .withColumn("block", F.least("width", "n"))
    )
    first, last = F.greatest(F.col("before") - F.col("block") + 1, F.lit(0)), F.least("before", F.size("around") - F.col("block"))
    shared = F.array_max(F.transform(F.sequence(first, last), lambda a: F.size(F.array_intersect("template", F.slice("around", a + 1, F.col("block"))))))
    return (
        found.withColumn("shared", shared).filter(F.col("shared") >= F.col("need"))
        .groupBy("doc_id", "th", "label", "no").agg(F.max(F.col("shared") / F.size("template")).alias("containment"))
    )


def _words(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = 0.85) -> DataFrame:
    """License phrases and notices in every text.

    Returns one row per input row: doc_id, n_words, n_base (places of the base
    phrases), first_word and last_word (their smallest and largest start in
    words from 0, else null), base_labels, labels (with the templates' labels;
    distinct, sorted, comma-joined) and score: 1 with a base phrase, else the
    largest containment that reached the threshold, else 0.  A null text counts
    as empty, repeated rows and rows with a null id each get their row, other
    columns are ignored whatever their names, an empty table gives an empty
    result.  Of a long text only the words around rare template words travel.
    """
    rows = texts(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("th", F.xxhash64("text"))
    base = base_phrases(rows)
    found = template_blocks(rows, templates, threshold).groupBy("doc_id", "th").agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    joined = join_rows(base, found)
    text = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        text(F.col("base")).alias("base_labels"),
        text(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
