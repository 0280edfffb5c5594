"""Queries over texts without words, nulls, blanks and letters beyond ASCII."""

import os

import pytest
from oracle import compare, duck
from pyspark.sql import functions as F

from lodestone import plans
from lodestone.functions import text as T
from lodestone.operators import windows as W

QUERIES, ORACLES = plans.queries(), plans.oracles()
TEXTS = (None, "", "   ", "\n\n", "\x0b", "！？", "中文文本 三", "İstanbul 1999", "K2 and more", "Größe 123 in 2019", "die Ausmaßen 123 x", "CSCI 567é and éAB 123",
         "CSCI\x0b567", "CSCI\u00a0567", "AB 123_ or x_AB 123", "²AB 123 日CD 456日", "ABC\f123 AB\r\n1234B")


def folder(spark, sf_dir, path, rows):
    """The smallest tables with further rows (doc_id, text, lang, source) of documents."""
    for name in os.listdir(sf_dir):
        if name != "documents.parquet":
            os.symlink(f"{sf_dir}/{name}", f"{path}/{name}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.unionByName(more.select(docs.columns)).coalesce(1).write.parquet(f"{path}/parts")
    part = next(f for f in os.listdir(f"{path}/parts") if f.endswith(".parquet"))
    os.rename(f"{path}/parts/{part}", f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("text, upper", [("straße", "STRAẞE"), ("ŉᾳ", "ŉᾼ"), ("de", "DE"), ("", ""), (None, None)])
def test_upper_case_character_by_character(spark, text, upper):
    assert spark.createDataFrame([(text,)], "t string").select(T.upper_each(F.col("t")).alias("x")).first()["x"] == upper


def test_dense_ids_keep_null_positions_last(spark):
    rows = W.dense_ids(spark.createDataFrame([(5,), (None,), (-3,), (200_000,)], "x long"), "x").collect()
    assert {r["x"]: r["row_id"] for r in rows} == {-3: 0, 5: 1, 200_000: 2, None: 3}


@pytest.mark.parametrize("text, word", [("", None), (None, None), ("！？", None), ("  --Ab9c d", "ab9c"), ("İstanbul", "istanbul"), ("é\u212aa", "ka")])
def test_first_word(spark, text, word):
    row = spark.createDataFrame([(text,)], "t string").select(T.first_word(F.col("t")).alias("x")).first()
    assert row["x"] == word


def test_chapters_with_wordless_texts_and_repeated_ids(spark, sf_dir, tmp_path):
    """Short wordless texts are no candidates, like missing ones; an id that comes
    twice is one candidate."""
    found = []
    for i, text in enumerate(("！？", None)):
        (tmp_path / str(i)).mkdir()
        d = folder(spark, sf_dir, tmp_path / str(i), [(1000 + j, text, "en", "src1") for j in range(3)])
        found.append(sorted(map(tuple, QUERIES["chapter_selection"](spark, d).collect())))
    assert found[0] == found[1] != []
    (tmp_path / "twice").mkdir()
    again = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat("text", F.lit(" end")), "lang", "source").collect()]
    units = [(r["code"], r["unit"]) for r in QUERIES["chapter_selection"](spark, folder(spark, sf_dir, tmp_path / "twice", again)).collect()]
    assert len(units) == len(set(units)) > 0


@pytest.fixture(scope="module")
def odd(spark, sf_dir, tmp_path_factory):
    """Every odd text in a known source and language, without either, and with blank ones."""
    traits = (("en", "src1"), (None, None), ("straße ŉᾳ", ""), ("", "  "), ("de", "src99"))
    rows = [(2000 + 10 * i + j, text, *t) for i, text in enumerate(TEXTS) for j, t in enumerate(traits)]
    return folder(spark, sf_dir, tmp_path_factory.mktemp("odd"), rows)


@pytest.mark.parametrize("name", [
    "coverage_by_category",
    "division_matrix",
    "readiness_divisions",
    "unit_union",
    "unit_projection",
    "course_codes", "marker_gate",
])
def test_odd_texts_match_sql(spark, odd, name):
    assert compare(QUERIES[name](spark, odd), duck(odd), ORACLES[name]) == ""
