"""Properties over random filter states on the sf0.001 fixture."""

from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import SF_SMALL
from incident_analytics import Circle, IncidentFilter, fixtures
from incident_analytics.functions.dates import default_range
from incident_analytics.operators import details, kpi, mapping, trends

AREAS = [f"NATION_{i}" for i in range(25)]
CATS = ["PERSON", "PROPERTY", "SOCIETY"]


@pytest.fixture(scope="module")
def inc(spark):
    return fixtures.incidents(spark, SF_SMALL).cache()


filters = st.builds(
    lambda start, days, hours, cats, areas, circle: IncidentFilter(
        start=start, end=start + dt.timedelta(days=days), hours=hours, categories=cats,
        areas=areas, circle=circle),
    start=st.dates(dt.date(2021, 12, 1), dt.date(2023, 12, 31)),
    days=st.integers(0, 800),
    hours=st.one_of(st.none(), st.tuples(st.integers(0, 24), st.integers(0, 24))),
    cats=st.one_of(st.none(), st.lists(st.sampled_from(CATS), unique=True, max_size=3)),
    areas=st.one_of(st.none(), st.lists(st.sampled_from(AREAS), unique=True, max_size=4)),
    circle=st.one_of(st.none(), st.builds(Circle, st.floats(47.5, 47.7), st.floats(-122.42, -122.25),
                                          st.sampled_from([161.0, 805.0, 3219.0]))),
)

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(flt=filters)
def test_table_and_map_are_subsets(inc, flt):
    matching = {r["incident_id"] for r in flt.apply(inc).select("incident_id").collect()}
    table = [r["incident_id"] for r in details.incident_details(inc, flt, n=50).collect()]
    pts = [r["incident_id"] for r in mapping.map_points(inc, flt, n=100).collect()]
    assert set(table) <= matching and len(table) == min(50, len(matching))
    assert set(pts) <= matching and len(pts) == min(100, len(matching))


@SETTINGS
@given(start=st.dates(dt.date(2021, 12, 1), dt.date(2023, 12, 31)), days=st.integers(0, 800))
def test_kpi_parts_within_total(inc, start, days):
    k = kpi.kpis(inc, start, start + dt.timedelta(days=days)).first()
    assert k["person"] + k["property"] + k["society"] <= k["total"]
    assert all(0.0 <= k[f"{c.lower()}_pct"] <= 100.0 for c in CATS)


@SETTINGS
@given(start=st.dates(dt.date(2022, 1, 1), dt.date(2023, 12, 1)))
def test_all_hours_is_identity(inc, start):
    a = IncidentFilter(start, None, hours=(0, 24)).apply(inc).count()
    b = IncidentFilter(start, None).apply(inc).count()
    assert a == b


def test_trend_totals_add_up(inc):
    """Count series of all areas (n = number of areas) sum to the rows before the cut."""
    series = trends.area_trends(inc, "2022-01-01", "2023-12-31", n=100, as_of="2023-10-10").collect()
    rows = IncidentFilter("2022-01-01", "2023-12-31").apply(inc)
    want = rows.where((rows.date < dt.date(2023, 10, 1)) & rows.area.isNotNull()).count()
    assert sum(r["value"] for r in series) == want


def test_default_range():
    s, e = default_range("2024-03-01")
    assert (e - s).days == 365 and e == dt.date(2024, 3, 1)
