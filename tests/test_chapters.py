"""Chapters chosen by hand-computed rules."""

import pytest

from lodestone.operators import chapters as C

SCHEMA = ("code string, unit long, score double, page string, entity string, host string, kind string, dup string, support boolean, boilerplate boolean, "
          "fit int, gap_score double, gap_place int, query_place int, kind_place int")


def row(unit, score=None, code="A", **traits):
    plain = dict(page=f"p{unit}", entity=f"e{unit}", host=f"h{unit}", kind="fact", dup=f"t{unit}", support=False, boilerplate=False,
                 fit=None, gap_score=None, gap_place=None, query_place=None, kind_place=None)
    return tuple({"code": code, "unit": unit, "score": score, **plain, **traits}.values())


def chosen(spark, rows, rules=C.Rules(size=6), fit_codes=()):
    out = C.choose_units(spark.createDataFrame(rows, SCHEMA), rules, fit_codes).collect()
    seated = [(r["unit"], r["phase"]) for r in sorted((r for r in out if r["seat"]), key=lambda r: r["seat"])]
    return seated, {r["unit"]: r["refused"] for r in out if r["refused"]}


def test_by_score_with_ties_to_the_smaller_unit(spark):
    seated, refused = chosen(spark, [row(3, 0.5), row(2, 0.5), row(1, 0.1), row(9, 0.9)], C.Rules(size=3))
    assert seated == [(9, "rank"), (2, "rank"), (3, "rank")] and refused == {}


@pytest.mark.parametrize("trait, most", [("page", 2), ("entity", 2), ("host", 4), ("dup", 1)])
def test_caps(spark, trait, most):
    rows = [row(i, 1 - i / 10, **{trait: "same"}) for i in range(6)]
    seated, refused = chosen(spark, rows)
    assert [u for u, _ in seated] == list(range(most))
    assert set(refused) == set(range(most, 6)) and set(refused.values()) == {"text" if trait == "dup" else trait}


def test_units_without_an_entity_share_none(spark):
    assert [u for u, _ in chosen(spark, [row(i, 1 - i / 10, entity=None) for i in range(4)])[0]] == [0, 1, 2, 3]


def test_support_boilerplate_and_kind(spark):
    rules = C.Rules(size=8)
    rows = [row(i, 1 - i / 100, support=True) for i in range(4)] + [row(10 + i, 0.8 - i / 100, boilerplate=True) for i in range(6)]
    seated, refused = chosen(spark, rows, rules)
    assert [u for u, _ in seated] == [0, 1, 10, 11, 12, 13] and refused == {2: "support", 3: "support", 14: "boilerplate", 15: "boilerplate"}
    rows = [row(i, 1 - i / 100, kind="chunk") for i in range(7)]
    assert [u for u, _ in chosen(spark, rows, rules)[0]] == [0, 1, 2, 3, 4]


def test_a_refusal_uses_up_nothing(spark):
    rows = [row(1, 0.9, page="p"), row(2, 0.8, page="p"), row(3, 0.7, page="p", entity="e"), row(4, 0.6, entity="e"), row(5, 0.5, entity="e"), row(6, 0.4, entity="e")]
    assert [u for u, _ in chosen(spark, rows)[0]] == [1, 2, 4, 5]


def test_reserved_seats_come_before_scores_and_queries_stay_first(spark):
    rows = [row(i, 1 - i / 100) for i in range(6)] + [row(20, 0.2, query_place=2), row(21, 0.1, query_place=1), row(22, 0.15, query_place=3),
                                                     row(30, None, gap_score=0.3, gap_place=1), row(31, None, gap_place=2)]
    seated, _ = chosen(spark, rows)
    # Six seats: one sixth for gaps, a third for queries, the rest by score.
    assert seated == [(21, "query"), (20, "query"), (0, "rank"), (1, "rank"), (2, "rank"), (30, "gap")]


def test_no_gap_seat_in_a_chapter_of_two(spark):
    assert [C.Rules(size=n).gap_seats() for n in (1, 2, 3, 9, 15, 24, 60)] == [0, 0, 1, 2, 2, 4, 4]
    assert chosen(spark, [row(1, 0.5), row(2, None, gap_place=1)], C.Rules(size=2))[0] == [(1, "rank")]


def test_floors_waive_hosts_only_and_prefer_their_order(spark):
    rules = C.Rules(size=6, floors={"course": 0.34, "org": 5}, kinds={})
    rows = [row(i, 1 - i / 100, host="h") for i in range(5)] + [row(10 + i, 0.5 - i / 100, host="h", kind="course", page="c") for i in range(3)]
    rows += [row(20, 0.1, kind="course", kind_place=1)]
    seated, refused = chosen(spark, rows, rules)
    # Two courses (a share of 0.34 of six): the preferred one, then the best; they count on the host.
    assert seated == [(0, "rank"), (1, "rank"), (2, "rank"), (10, "floor"), (20, "floor")]
    assert refused[3] == "host" and refused[11] == "host"


def test_organisations_need_a_fit_where_any_has_one(spark):
    rows = [row(1, 0.9, kind="org", fit=0), row(2, 0.8, kind="org", fit=2), row(3, 0.7, kind="org"), row(4, 0.6)]
    assert [u for u, _ in chosen(spark, rows, fit_codes=("A",))[0]] == [2, 4]
    assert [u for u, _ in chosen(spark, rows)[0]] == [1, 2, 3, 4]
    unfit = [row(1, 0.9, kind="org"), row(4, 0.6)]
    assert [u for u, _ in chosen(spark, unfit, fit_codes=("A",))[0]] == [1, 4]


def test_chapters_do_not_share_caps_and_empty_tables_give_none(spark):
    rows = [row(1, 0.9, dup="x"), row(2, 0.8, code="B", dup="x")]
    assert sorted(chosen(spark, rows)[0]) == [(1, "rank"), (2, "rank")]
    assert chosen(spark, []) == ([], {})
