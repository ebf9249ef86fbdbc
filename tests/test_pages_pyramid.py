"""Keyset pages give the sorted table; the pyramid gives the rows' answers."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from incident_analytics import Circle, IncidentFilter, fixtures
from incident_analytics.operators import details, mapping, pyramid
from incident_analytics.session import scratch_path


@pytest.mark.parametrize("sort_by,ascending,ids", [(None, True, True), ("hazard_score", False, True), ("hazard_score", True, True),
                                                   ("area", True, False), ("location", False, False)])
def test_pages_together_are_the_sorted_table(spark, sort_by, ascending, ids):
    r = random.Random(4)
    rows = [(i, r.choice([None, "2023-01-01 10:00:00", "2023-01-02 09:00:00"]), r.choice([None, "a", "b"]),
             r.choice([None, 1.5, 2.0, float("nan")]), r.choice(["x", None])) for i in range(70)]
    table = spark.createDataFrame(rows, "incident_id LONG, date_time STRING, area STRING, hazard_score DOUBLE, location STRING")
    if not ids:
        table = table.drop("incident_id").distinct()
    table = table.repartition(4).cache()
    asked = dict(size=9, sort_by=sort_by, ascending=ascending)
    paged, last = [], None
    while page := details.page_after(table, last, **asked).collect():
        paged, last = paged + page, page[-1]
    whole = details.details_page(table, size=1000, sort_by=sort_by, ascending=ascending).collect()
    assert str(paged) == str(whole) and len(paged) == table.count()


def test_a_page_sorts_nothing_before_it(spark, make_incidents):
    from incident_analytics.plans import plan_text
    table = details.incident_details(make_incidents([]), IncidentFilter())
    last = {"incident_id": 5, "date_time": "2023-01-01 00:00:00", "hazard_score": None}
    plan = plan_text(details.page_after(table, last, sort_by="hazard_score"))
    assert "offset" not in plan.lower() and plan.count("TakeOrderedAndProject") >= 1


FILTERS = [IncidentFilter(), IncidentFilter("2022-05-01", "2023-02-01", hours=(6, 22)), IncidentFilter(hours=(22, 24), categories="PERSON"),
           IncidentFilter(categories=[]), IncidentFilter(end="2022-12-31", end_inclusive=False)]


def test_pyramid_equals_rows(spark):
    inc = fixtures.incidents(spark, SF_SMALL).cache()
    path = scratch_path(spark, "t-pyramid")
    third = F.pmod("incident_id", F.lit(3)) == 0
    pyramid.write_spatial_summary(inc.where(third), path)
    pyramid.write_spatial_summary(inc.where(~third), path, mode="append")
    built = pyramid.read_spatial_summary(spark, path)
    for flt in FILTERS:
        assert (sorted(map(tuple, pyramid.location_frequency(built, flt).collect()))
                == sorted(map(tuple, mapping.location_frequency(inc, flt).collect())))
        rows = flt.apply(inc)
        totals = pyramid.map_totals(built, flt, n=40).collect()
        assert sum(t["matching"] for t in totals) == rows.count()
        assert {(t["matching_total"], t["shown_total"]) for t in totals} <= {(rows.count(), min(rows.count(), 40))}
        stats = mapping.map_stats(inc, flt, n=40).collect()
        assert not totals or {(s["matching_total"], s["shown_total"]) for s in stats} == {(rows.count(), min(rows.count(), 40))}
        for level in pyramid.LEVELS:
            assert (pyramid.density(built, flt, level).agg(F.sum("incidents")).first()[0] or 0) == rows.count()
    assert built.where("level = 12").count() < built.where("level = 0").count()
    for flt in (IncidentFilter(areas="X"), IncidentFilter(circle=Circle(47.6, -122.3)), IncidentFilter(polygon=[[0, 0], [1, 0], [1, 1]])):
        with pytest.raises(ValueError):
            pyramid.location_frequency(built, flt)
