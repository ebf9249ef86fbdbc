"""The daily summary answers the date-only views exactly like the raw rows."""

from __future__ import annotations

import pytest

from conftest import SF_MID
from incident_analytics import Circle, IncidentFilter, fixtures
from incident_analytics.operators import breakdown, kpi, options, summary, trends
from incident_analytics.session import scratch_path

VIEWS = {
    "profile": lambda d: kpi.profile(d),
    "selection": lambda d: kpi.selection_summary(d, "2023-02-01", "2023-05-31"),
    "kpis": lambda d: kpi.kpis(d, "2022-06-01", "2023-06-30"),
    "category_counts": lambda d: kpi.category_counts(d),
    "options": lambda d: options.area_options(d),
    "trend": lambda d: trends.area_trends(d, "2022-01-01", "2023-12-31", metric="hazard", as_of="2023-09-09"),
    "trend_bottom_empty": lambda d: trends.area_trends(d, "2023-01-01", "2023-03-31", order="bottom",
                                                       as_of="2023-03-15", include_empty=True),
    "breakdown": lambda d: breakdown.category_breakdown(d, "2023-01-01", "2023-12-31"),
    "rollup": lambda d: breakdown.category_rollup(d),
    "drill_empty": lambda d: breakdown.subcategory_breakdown(d, "SOCIETY", include_empty=True),
}


@pytest.fixture(scope="module")
def tables(spark):
    raw = fixtures.incidents(spark, SF_MID).cache()
    path = summary.write_summary(raw, scratch_path(spark, "t-summary"))
    return raw, summary.read_summary(spark, path)


@pytest.mark.parametrize("name", sorted(VIEWS))
def test_summary_equals_raw(tables, name):
    raw, summ = tables
    a = sorted(map(tuple, VIEWS[name](raw).collect()), key=repr)
    b = sorted(map(tuple, VIEWS[name](summ).collect()), key=repr)
    assert a == b


def test_summary_is_smaller_and_refuses_row_filters(tables):
    raw, summ = tables
    assert summ.agg({"n": "sum"}).first()[0] == raw.count()
    assert summ.count() < raw.count()
    for flt in (IncidentFilter(hours=(1, 5)), IncidentFilter(circle=Circle(47.6, -122.3)),
                IncidentFilter(polygon=[[0, 0], [1, 0], [1, 1]])):
        with pytest.raises(ValueError):
            flt.apply(summ)
    assert IncidentFilter(hours=(0, 24), areas="NATION_1").apply(summ).count() > 0


def test_appended_summaries_still_sum(spark, tables):
    raw, _ = tables
    path = scratch_path(spark, "t-summary-append")
    first, second = raw.where(raw.incident_id % 2 == 0), raw.where(raw.incident_id % 2 == 1)
    summary.write_summary(first, path)
    summary.write_summary(second, path, mode="append")   # same keys appear twice
    summ = summary.read_summary(spark, path)
    assert sorted(map(tuple, kpi.kpis(summ).collect())) == sorted(map(tuple, kpi.kpis(raw).collect()))
    got = trends.area_trends(summ, as_of="2024-01-01").collect()
    want = trends.area_trends(raw, as_of="2024-01-01").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
