"""Sums of scores of any size: exact, in any order and split."""

from __future__ import annotations

import datetime as dt
import math
import random
from fractions import Fraction

import pytest

from incident_analytics.operators import summary, trends
from incident_analytics.session import scratch_path


def sums(spark, groups: dict[str, list], partitions: int) -> dict[str, float]:
    rows = [(k, x) for k, xs in groups.items() for x in xs]
    random.Random(partitions).shuffle(rows)
    df = spark.createDataFrame(rows, "k STRING, hazardness DOUBLE").repartition(partitions)
    return {r["k"]: r["h"] for r in summary.hazard_sums(summary.counted(df), "k").collect()}


def wide(seed: int) -> list[float]:
    r = random.Random(seed)
    return [r.choice([-1, 1]) * math.ldexp(r.random(), r.randint(-1074, 1000)) for _ in range(300)]


def test_one_band_is_rounded_once(spark):
    """Scores of one size class: the sum is the exact one, rounded once."""
    r = random.Random(1)
    groups = {"a": [r.uniform(16, 255) for _ in range(2000)], "b": [0.1] * 999, "c": [1e300] * 7, "d": [5e-324] * 3,
              "e": [2.0**8, 2.0**16 - 2.0**-37], "f": [0.0, None, float("nan"), -0.0], "g": [1.7e308, 1.7e308]}
    got = sums(spark, groups, 3)
    assert got["g"] == math.inf and got["f"] == 0.0
    for k in "abcd":
        assert got[k] == float(sum(map(Fraction, groups[k]))), k
    assert got["e"] == 2.0**8 + (2.0**16 - 2.0**-37)


@pytest.mark.parametrize("seed", range(3))
def test_wide_sums_do_not_depend_on_the_split(spark, seed):
    groups = {"w": wide(seed), "x": [1e300, 1.0, -1e300, 3.0], "y": [1e10, 1e-10] * 50}
    one, many = sums(spark, groups, 1), sums(spark, groups, 200)
    assert one == many
    exact = float(sum(map(Fraction, groups["w"])))
    assert math.isclose(one["w"], exact, rel_tol=1e-15) and one["x"] == 4.0
    assert math.isclose(one["y"], float(sum(map(Fraction, groups["y"]))), rel_tol=1e-15)


def test_infinities_and_views(spark, make_incidents):
    day = dt.date(2023, 3, 1)
    scores = {"plus": [math.inf, 1.0], "minus": [-math.inf, 1e300], "both": [math.inf, -math.inf, 2.0], "nan": [math.nan, 4.0],
              "big": [1e10, 1e300], "null": [None, 3.0]}
    df = make_incidents([{"incident_id": i, "date": day, "area": a, "hazardness": h, "latitude": 47.6, "longitude": -122.3,
                          "crime_against_category": "PERSON", "offense_sub_category": "x"}
                         for i, (a, h) in enumerate((a, h) for a, hs in scores.items() for h in hs)])
    path = summary.write_summary(df, scratch_path(spark, "t-extreme"))
    for table in (df, summary.read_summary(spark, path)):
        got = {r["area"]: r["value"] for r in trends.area_trends(table, metric="hazard", as_of="2024-01-01").collect()}
        assert math.isnan(got.pop("both"))
        assert got == {"plus": math.inf, "minus": -math.inf, "nan": 2.0, "big": 5e299, "null": 1.5}
        counts = {r["area"]: r["value"] for r in trends.area_trends(table, as_of="2024-01-01").collect()}
        assert counts == {a: float(len(hs)) for a, hs in scores.items()}


def test_count_trend_sums_no_score(make_incidents):
    from incident_analytics.plans import plan_text
    daily = trends.daily_area_totals(make_incidents([]), as_of="2024-01-01", hazard=False)
    assert "LOG2" not in plan_text(daily).upper() and daily.columns == ["date", "area", "n"]
