"""Quality measures: set similarity, drift, gates, rubric scores, run comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def mean_pairwise_jaccard(rows: DataFrame, profile: str, category: str, unit: str) -> DataFrame:
    """Mean Jaccard similarity of the profiles' unit sets, by category: the sizes
    of intersections come from an equi-join on units, not from all pairs of
    sets; pairs without a common unit count as 0 through their number."""
    sets = rows.select(F.col(category).alias("category"), F.col(profile).alias("p"), F.col(unit).alias("u")).distinct()
    sizes = sets.groupBy("category", "p").agg(F.count(F.lit(1)).alias("n"))
    other = sets.withColumnRenamed("p", "p2")
    both = sets.join(other, ["category", "u"]).filter(F.col("p") < F.col("p2")).groupBy("category", "p", "p2").agg(F.count(F.lit(1)).alias("shared"))
    scored = both.join(sizes, ["category", "p"]).join(sizes.withColumnsRenamed({"p": "p2", "n": "n2"}), ["category", "p2"])
    total = scored.groupBy("category").agg(F.sum(F.col("shared") / (F.col("n") + F.col("n2") - F.col("shared"))).alias("s"))
    pairs = sizes.groupBy("category").agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1) / 2).alias("pairs"))
    return pairs.filter(F.col("pairs") > 0).join(total, "category", "left").select(
        "category", F.round(F.coalesce("s", F.lit(0.0)) / F.col("pairs"), 6).alias("mean_jaccard"))


def shared_word_strength(rows: DataFrame, key: str, words: str, weight: str, most_words: int = 12) -> DataFrame:
    """Each row's weight plus that of every other row that shares a word with it.

    With W(S) the weight of all rows that hold every word of S, the weight of the
    rows that share a word is the sum of W(S) over all sets S of the row's words,
    odd sizes added, even ones subtracted.  A row gives 2**words - 1 sets, so no
    word, however common, pairs its holders; rows of more than ``most_words``
    words are an error."""
    n = F.size(words)
    guarded = F.when(n <= most_words, n).otherwise(F.raise_error(F.lit(f"more than {most_words} words")).cast("int"))
    masks = F.when(n > 0, F.sequence(F.lit(1), F.shiftleft(F.lit(1), most_words) - 1)).otherwise(F.array().cast("array<int>"))
    masks = F.slice(masks, F.lit(1), F.pow(F.lit(2), guarded).cast("int") - 1)
    sets = F.transform(masks, lambda m: F.filter(F.col(words), lambda w, i: m.bitwiseAND(F.element_at(F.array(*[F.lit(1 << b) for b in range(most_words)]), i + 1)) != 0))
    held = rows.select(key, F.col(weight).alias("w"), F.explode(sets).alias("s"))
    total = held.groupBy("s").agg(F.sum("w").alias("total"))
    sign = F.when(F.size("s") % 2 == 1, 1).otherwise(-1)
    near = held.join(total, "s").groupBy(key).agg(F.sum(sign * F.col("total")).alias("near"))
    return rows.join(near, key, "left").select(*rows.columns, F.coalesce("near", F.col(weight)).cast("long").alias("strength"))


def compare_runs(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of two runs: kept, changed, added and gone, by one full outer join."""
    a = old.select(F.col(key).alias("k"), F.col(value).alias("v_old"), F.lit(True).alias("in_old"))
    b = new.select(F.col(key).alias("k"), F.col(value).alias("v_new"), F.lit(True).alias("in_new"))
    state = (
        F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "gone")
        .when(F.col("v_old").eqNullSafe(F.col("v_new")), "kept").otherwise("changed")
    )
    return a.join(b, "k", "full").select("k", state.alias("state"))


def claim_state(det1: Column, model1: Column, candidate: Column, det2: Column, model2: Column) -> Column:
    """Final verdict of a claim as one expression of five inputs: deterministic
    finding (non_factual, hard, soft, grounded, clean), model verdict, whether a
    correction exists, and both checks of the correction."""
    corrected = F.when(candidate & (det2 == "clean") & (model2 == "supported"), "corrected").otherwise("unsupported")
    return (
        F.when(det1 == "non_factual", "supported").when(det1 == "hard", "unsupported")
        .when(model1.isNull(), F.when(det1 == "grounded", "supported").otherwise("unsupported"))
        .when(model1 == "unsupported", "unsupported")
        .when(model1 == "overreach", corrected).when(det1 == "soft", corrected).otherwise("supported")
    )


def undergraduate_number(number: Column) -> Column:
    """Course level by digits: four or more with a leading 0 are unpadded, then
    the first digit must be 0 to 4."""
    digits = F.regexp_replace(number, "[^0-9]", "")
    plain = F.when((F.length(digits) >= 4) & digits.startswith("0"), F.regexp_replace(digits, "^0+", "")).otherwise(digits)
    return F.when(plain == "", F.lit(None).cast("boolean")).otherwise(F.substring(plain, 1, 1).between("0", "4"))


def rubric(flags: dict[str, float]) -> Column:
    """Weighted score of boolean flags, 0 to 10."""
    total = sum(F.when(F.col(name), F.lit(weight)).otherwise(F.lit(0.0)) for name, weight in flags.items())
    return F.least(F.lit(10.0), F.greatest(F.lit(0.0), total))
