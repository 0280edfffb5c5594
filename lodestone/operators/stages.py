"""Stages around a model: batches, retries, resumed keys; the gates on what it returns."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from ..functions import text as T
from ..sources.shared import cut
from .windows import dense_ids

Model = Callable[[list[str], int], list[str]]


def asked_in_batches(rows: DataFrame, key: str, prompt: str, model: Model, turn: int, size: int) -> DataFrame:
    """(key, response): prompts go to the model in batches; where a batch does
    not come back with one response each, its prompts are asked one by one."""
    schema = rows.select(key).schema.add("response", StringType())

    def run(batches):
        for pdf in batches:
            out: list[str | None] = []
            for at in range(0, len(pdf), size):
                some = pdf[prompt].iloc[at : at + size].tolist()
                got = model(some, turn)
                if len(got) != len(some):
                    alone = [model([p], turn) for p in some]
                    got = [g[0] if len(g) == 1 else None for g in alone]
                out += got
            yield pd.DataFrame({key: pdf[key], "response": out})

    return rows.select(key, prompt).mapInPandas(run, schema)


def model_stage(rows: DataFrame, key: str, prompt: str, model: Model, schema: str, accepted: Column, turns: int = 3, size: int = 8, done: DataFrame | None = None) -> DataFrame:
    """Ask the model for every key that ``done`` lacks, and again for those whose
    response breaks ``schema`` or ``accepted`` (a condition on ``answer``).

    Returns key, answer (null if no turn gave one that passes) and turn (1 up to
    ``turns``, the one that counted).  Each turn's responses are written to the
    shared folder before they are judged: a lost executor asks nothing twice
    once a turn is written, and turn n + 1 sees only what turn n left.
    """
    pending = rows.select(key, prompt)
    if done is not None:
        pending = pending.join(done.select(key), key, "left_anti")
    settled = None
    for turn in range(1, turns + 1):
        replies = cut(asked_in_batches(pending, key, prompt, model, turn, size), "replies")
        judged = replies.select(key, F.from_json("response", schema).alias("answer")).withColumn("ok", F.coalesce(accepted, F.lit(False)))
        passed = judged.filter("ok") if turn < turns else judged.withColumn("answer", F.when(F.col("ok"), F.col("answer")))
        passed = passed.select(key, "answer", F.lit(turn).cast(IntegerType()).alias("turn"))
        settled = passed if settled is None else settled.unionByName(passed)
        pending = pending.join(judged.filter("NOT ok").select(key), key, "left_semi")
    return settled


def item_fate(evidence: Column, page: Column, quarantined: Column, least: int = 8) -> Column:
    """Why an item drawn from a page goes, null if it stays: its line is too short
    (unless it stands there as whole words), not there, or quarantined."""
    needle, haystack, bad = (T.alnum_form(F.coalesce(c, F.lit(""))) for c in (evidence, page, quarantined))
    whole = F.concat(F.lit(" "), haystack, F.lit(" ")).contains(F.concat(F.lit(" "), needle, F.lit(" "))) & (needle != "")
    return (
        F.when((F.length(needle) < least) & ~whole, "short")
        .when(~haystack.contains(needle), "absent")
        .when((bad != "") & (bad.contains(needle) | needle.contains(bad)), "quarantined")
    )


def blind_batches(items: DataFrame, key: str, versions: int, batches: int, seed: str, width: int = 1 << 20) -> DataFrame:
    """Each version of an item in another batch, no batch more than one ahead.

    Items stand in a random order that the seed fixes; version v of the i-th item
    goes to batch (i * versions + v) modulo the number of batches, of which there
    must be at least as many as versions.  The label says nothing of the version.
    """
    if batches < versions:
        raise ValueError("every version of an item needs a batch of its own")
    place = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed))), 1, 15), 16, 10).cast("long")
    drawn = dense_ids(items.select(key).distinct().withColumn("place", place), "place", width=1 << 44)
    spread = drawn.withColumn("version", F.explode(F.sequence(F.lit(0), F.lit(versions - 1))))
    label = F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col("version").cast("string"), F.lit(seed), F.lit("label"))), 1, 12)
    return spread.select(key, "version", F.pmod(F.col("row_id") * versions + F.col("version"), F.lit(batches)).cast("long").alias("batch"), label.alias("label"))


def extraction_chunks(text: str, most: int = 12_000, limit: int | None = 14) -> list[str]:
    """Blocks that begin at headings, packed up to ``most`` characters; a longer
    block is cut hard.  At most ``limit`` chunks (None: all)."""
    chunks, held = [], ""
    for block in re.split(r"\n(?=#)", text):
        if held and len(held) + len(block) > most:
            chunks.append(held)
            held = ""
        whole = (len(block) - 1) // most * most if block else 0
        chunks += [block[i : i + most] for i in range(0, whole, most)]
        held += block[whole:] + "\n"
    if held.strip():
        chunks.append(held)
    return chunks[:limit]
