"""Choosing the units of a chapter: reserved seats, floors and joint caps in one pass."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut


@dataclass(frozen=True)
class Rules:
    """How many units a chapter takes and how many may share a trait.  A floor
    below one is a share of the chapter.  Fixed values: the defaults."""

    size: int = 24
    page: int = 2
    entity: int = 2
    host: int = 4
    boilerplate: int = 4
    kinds: dict[str, int] = field(default_factory=lambda: {"chunk": 5})
    support_share: float = 0.25
    gap_share: float = 1 / 6
    most_gaps: int = 4
    floors: dict[str, float] = field(default_factory=dict)
    least_fit: int = 1

    def gap_seats(self) -> int:
        return 0 if self.size <= 2 else max(1, min(self.most_gaps, round(self.size * self.gap_share)))

    def query_seats(self) -> int:
        return max(1, self.size // 3)

    def floor_of(self, kind: str) -> int:
        wanted = self.floors[kind]
        return max(1, round(wanted * self.size)) if 0 < wanted < 1 else int(wanted)

    def traits(self, row) -> list[tuple[str, object, int]]:
        """Traits that a unit uses up, each with how many units may have it."""
        found = [("text", row.dup, 1)] if row.dup else []
        found += [("page", row.page, self.page)]
        found += [("entity", row.entity, self.entity)] if row.entity else []  # units without one share none
        found += [("host", row.host, self.host)]
        if row.kind in self.kinds:
            found.append(("kind", row.kind, self.kinds[row.kind]))
        if row.support:
            found.append(("support", None, int(self.size * self.support_share)))
        if row.boilerplate:
            found.append(("boilerplate", None, self.boilerplate))
        return found


class Chapter:
    """One chapter while its seats are given out."""

    def __init__(self, rules: Rules, fit_gate: bool):
        self.rules, self.fit_gate = rules, fit_gate
        self.used: Counter = Counter()
        self.phase: dict = {}
        self.refused: dict = {}

    def full(self) -> bool:
        return len(self.phase) >= self.rules.size

    def admit(self, row, phase: str, waive: str = "") -> bool:
        """Seat a unit unless a trait of it is used up; a refusal uses up nothing."""
        traits = self.rules.traits(row)
        over = next((name for name, value, most in traits if name != waive and self.used[name, value] >= most), None)
        if over is None and self.fit_gate and row.kind == "org" and row.fit < self.rules.least_fit:
            over = "fit"
        if over is not None:
            self.refused[row.unit] = over
            return False
        self.used.update((name, value) for name, value, _ in traits)
        self.phase[row.unit] = phase
        return True

    def seat(self, rows, phase: str, most: int, waive: str = "") -> None:
        """Seat up to ``most`` further units of ``rows``, in their order."""
        given = 0
        for row in rows:
            if given >= most or self.full():
                return
            if row.unit not in self.phase:
                given += self.admit(row, phase, waive)


CHOSEN = "code string, unit long, seat int, phase string, refused string"


def choose_units(candidates: DataFrame, rules: Rules = Rules(), fit_codes: tuple[str, ...] = ()) -> DataFrame:
    """Choose each chapter's (code's) units.

    Columns: code, unit, score (null for units that only a gap search found),
    page, entity, host, kind, dup (text key), support, boilerplate (booleans),
    fit, gap_score (orders those in the result), gap_place, query_place,
    kind_place (nullable places in the gap hits, in the queries' best hits and in
    the preferred order of a kind).

    Seats go to gap hits, then to queries' best hits, then to floors of kinds
    (without the cap on hosts), then by score; every seat respects all caps.  Of
    chapters in ``fit_codes`` an organisation needs a fit, if any unit at all has
    one.  Queries' seats come first in the result, the rest by score.  Returns one
    row per candidate: seat and phase if chosen, the cap that refused it last if not.

    A chapter's candidates are the union of its top-k lists, so a group is as
    small as k times its number of lists; what one cap refuses uses up none of
    the others, which no window can state.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(fit=pdf["fit"].fillna(0))
        code = pdf["code"].iloc[0]
        in_order = lambda part, *by: list(part.sort_values([*by, "unit"]).itertuples())
        scored = pdf[pdf["score"].notna()].assign(down=lambda x: -x["score"])
        ranked = in_order(scored, "down")
        chapter = Chapter(rules, code in fit_codes and bool(pdf["any_fit"].iloc[0]))
        chapter.seat(in_order(pdf[pdf["gap_place"].notna()], "gap_place"), "gap", rules.gap_seats())
        chapter.seat(in_order(scored[scored["query_place"].notna()], "query_place"), "query", rules.query_seats())
        for kind in sorted(rules.floors):
            own = scored[scored["kind"] == kind]
            preferred = in_order(own[own["kind_place"].notna()], "kind_place")
            chapter.seat(preferred + in_order(own, "down"), "floor", rules.floor_of(kind), waive="host")
        chapter.seat(ranked, "rank", rules.size)
        by_unit = pdf.set_index("unit")
        scores = by_unit["score"].fillna(by_unit["gap_score"]).fillna(0.0)
        first = [u for u, phase in chapter.phase.items() if phase == "query"]
        rest = sorted((u for u in chapter.phase if u not in first), key=lambda u: (-scores[u], u))
        seats = {u: i for i, u in enumerate(first + rest, 1)}
        out = pdf[["code", "unit"]].copy()
        out["seat"] = out["unit"].map(seats).astype("Int32")
        out["phase"] = out["unit"].map(chapter.phase)
        out["refused"] = out["unit"].map({u: r for u, r in chapter.refused.items() if u not in chapter.phase})
        return out.astype({"phase": object, "refused": object})

    if not fit_codes:
        return candidates.withColumn("any_fit", F.lit(False)).groupBy("code").applyInPandas(run, CHOSEN)
    candidates = cut(candidates, "candidates")  # read for the gate and for the choice
    gate = candidates.agg(F.coalesce(F.max(F.col("fit") > 0), F.lit(False)).alias("any_fit"))
    return candidates.crossJoin(F.broadcast(gate)).groupBy("code").applyInPandas(run, CHOSEN)  # one row
