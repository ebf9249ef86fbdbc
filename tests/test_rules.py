"""Rule tests: one small hand-made frame per semantic decision."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from incident_analytics import Circle, IncidentFilter
from incident_analytics.operators import breakdown, details, kpi, mapping, options, trends

D = dt.date


def _row(i, date=D(2023, 1, 1), hour=10, cat="PERSON", area="A", sub="S_1", h=1.0,
         lat=47.6, lon=-122.3, datetime=None, **kw):
    base = dict(incident_id=i, date=date, hour=hour, crime_against_category=cat, area=area,
                offense_sub_category=sub, hazardness=h, latitude=lat, longitude=lon,
                datetime=datetime if datetime is not None else (f"{date} {hour:02d}:00:00" if date else None),
                location="1XX BLOCK OF MAIN ST")
    base.update(kw)
    return base


def ids(df):
    return sorted(r["incident_id"] for r in df.select("incident_id").collect())


# Q1: end bound inclusive by default; exclusive on request.
def test_end_bound(make_incidents):
    df = make_incidents([_row(1, D(2023, 1, 1)), _row(2, D(2023, 1, 31)), _row(3, D(2023, 2, 1))])
    assert ids(IncidentFilter("2023-01-01", "2023-01-31").apply(df)) == [1, 2]
    assert ids(IncidentFilter("2023-01-01", "2023-01-31", end_inclusive=False).apply(df)) == [1]
    assert ids(IncidentFilter(D(2023, 1, 2), None).apply(df)) == [2, 3]


# Q2: empty category list → nothing; empty or missing area list → everything.
def test_empty_lists(make_incidents):
    df = make_incidents([_row(1, area="A"), _row(2, area="B", cat="SOCIETY")])
    assert ids(IncidentFilter(categories=[]).apply(df)) == []
    assert ids(IncidentFilter(areas=[]).apply(df)) == [1, 2]
    assert ids(IncidentFilter(areas="B").apply(df)) == [2]
    assert ids(IncidentFilter(categories=["SOCIETY"]).apply(df)) == [2]
    assert ids(IncidentFilter(categories="SOCIETY").apply(df)) == [2]


# Q3: hours inclusive, end capped at 23, (0, 24) is no filter, no wrap.
def test_hours(make_incidents):
    df = make_incidents([_row(i, hour=h) for i, h in enumerate([0, 5, 22, 23])])
    assert ids(IncidentFilter(hours=(0, 24)).apply(df)) == [0, 1, 2, 3]
    assert ids(IncidentFilter(hours=(22, 23)).apply(df)) == ids(IncidentFilter(hours=(22, 24)).apply(df)) == [2, 3]
    assert ids(IncidentFilter(hours=(24, 24)).apply(df)) == []
    assert ids(IncidentFilter(hours=(23, 5)).apply(df)) == []


# rows without coordinates never reach a view; the profile still counts them.
def test_coordinates_required(make_incidents):
    df = make_incidents([_row(1), _row(2, lat=None), _row(3, lon=None)])
    assert ids(IncidentFilter().apply(df)) == [1]
    p = kpi.profile(df).first()
    assert (p["records"], p["records_with_coords"]) == (3, 1)


# Q4 + Q18: null keys leave groups but count in totals; percentages 0 on empty input.
def test_kpis_nulls_and_empty(make_incidents):
    df = make_incidents([_row(1, cat="PERSON"), _row(2, cat=None), _row(3, cat="SOCIETY")])
    k = kpi.kpis(df).first()
    assert (k["total"], k["person"], k["property"], k["society"]) == (3, 1, 0, 1)
    assert k["person_pct"] == pytest.approx(100 / 3)
    assert {r["crime_against_category"] for r in kpi.category_counts(df).collect()} == {"PERSON", "SOCIETY"}
    empty = kpi.kpis(df, "2030-01-01", "2030-12-31").first()
    assert empty["total"] == 0 and empty["person_pct"] == 0.0


# Days between bounds is end − start (not inclusive); share of all rows.
def test_selection_summary(make_incidents):
    df = make_incidents([_row(1, D(2023, 1, 5)), _row(2, D(2023, 3, 1)), _row(3, D(2023, 1, 6), lat=None)])
    s = kpi.selection_summary(df, "2023-01-01", "2023-01-31").first()
    assert (s["selected"], s["total"], s["days"]) == (1, 3, 30)
    assert s["selected_pct"] == pytest.approx(100 / 3)


# Q6 + Q7: ranking ties by name; bottom is the tail of the descending list;
# hazard mean treats null as 0.
def test_trend_ranking(make_incidents):
    rows = []
    i = 0
    for area, n in [("A", 3), ("B", 2), ("C", 2), ("D", 1)]:
        for _ in range(n):
            i += 1
            rows.append(_row(i, D(2023, 1, 10), area=area, h=None if area == "A" else 4.0))
    df = make_incidents(rows)
    top2 = trends.area_trends(df, metric="count", order="top", n=2, as_of="2024-01-01")
    assert sorted(r["area"] for r in top2.collect()) == ["A", "B"]
    bottom2 = trends.area_trends(df, metric="count", order="bottom", n=2, as_of="2024-01-01")
    assert sorted(r["area"] for r in bottom2.collect()) == ["C", "D"]
    hz = {r["area"]: r["value"] for r in trends.area_trends(df, metric="hazard", n=4, as_of="2024-01-01").collect()}
    assert hz["A"] == 0.0 and hz["B"] == 4.0


# With ≤ n areas, top and bottom lists hold the same areas.
def test_top_equals_bottom_when_few(make_incidents):
    df = make_incidents([_row(1, area="A"), _row(2, area="B"), _row(3, area="B")])
    top = trends.area_trends(df, n=10, as_of="2024-01-01").collect()
    bottom = trends.area_trends(df, order="bottom", n=10, as_of="2024-01-01").collect()
    assert sorted(map(tuple, top)) == sorted(map(tuple, bottom))


# Q8 + Q10: bucket from the data span (>180 month, >60 week, else day);
# weeks start on Monday.
@pytest.mark.parametrize("span,grain", [(181, "month"), (180, "week"), (61, "week"), (60, "day")])
def test_granularity(make_incidents, span, grain):
    start = D(2023, 1, 4)  # a Wednesday
    df = make_incidents([_row(1, start), _row(2, start + dt.timedelta(days=span))])
    out = trends.area_trends(df, as_of="2025-01-01").collect()
    assert {r["granularity"] for r in out} == {grain}
    periods = sorted(r["period"] for r in out)
    if grain == "week":
        assert periods[0] == D(2023, 1, 2) and periods[0].weekday() == 0
    if grain == "month":
        assert periods[0] == D(2023, 1, 1)


# Q9: the month of ``as_of`` and later is cut.
def test_month_cut(make_incidents):
    df = make_incidents([_row(1, D(2023, 6, 30)), _row(2, D(2023, 7, 1)), _row(3, D(2023, 7, 20))])
    out = trends.area_trends(df, as_of="2023-07-15").collect()
    assert [r["period"] for r in out] == [D(2023, 6, 30)]


# W1 + W2 + G2: top-k per category with tie-break by name, opacity floor,
# labels cut at 40 characters.
def test_breakdown(make_incidents):
    rows = []
    i = 0
    for k in range(12):
        for _ in range(12 - k):
            i += 1
            rows.append(_row(i, sub=f"S_{k:02d}"))
    i += 1
    rows.append(_row(i, sub="X" * 45, cat="SOCIETY"))
    df = make_incidents(rows)
    out = breakdown.category_breakdown(df).where(F.col("crime_against_category") == "PERSON").collect()
    assert [r["rank"] for r in out] == list(range(1, 11))
    assert out[0]["offense_sub_category"] == "S_00" and out[0]["opacity"] == pytest.approx(0.9)
    assert out[-1]["opacity"] == pytest.approx(0.45)
    assert out[0]["category_total"] == sum(range(1, 13))
    drill = breakdown.subcategory_breakdown(df, "SOCIETY").first()
    assert drill["label"] == "X" * 40 + "..."
    roll = {(r["crime_against_category"], r["level"]): r["incidents"]
            for r in breakdown.category_rollup(df).collect() if r["level"] > 0}
    assert roll[(None, 3)] == len(rows) and roll[("SOCIETY", 1)] == 1


# Q12 + Q14: detail rows latest first, unparseable datetimes last; hazard half-even.
def test_details(make_incidents):
    df = make_incidents([
        _row(1, datetime="2023-01-01 10:00:00", h=0.25),
        _row(2, datetime="not a time", h=0.75),
        _row(3, datetime="2023-01-02 09:00:00", h=None),
    ])
    out = details.incident_details(df, IncidentFilter(), n=500).collect()
    assert [r["incident_id"] for r in out] == [3, 1, 2]
    assert out[1]["hazard_score"] == 0.2 and out[2]["hazard_score"] == 0.8
    assert out[2]["date_time"] is None
    page = details.details_page(details.incident_details(df, IncidentFilter()), page=1, size=2).collect()
    assert [r["incident_id"] for r in page] == [2]
    table = details.incident_details(df, IncidentFilter())
    hot = details.details_page(table, where=details.table_filter([("hazard_score", ">", 0.5),
                                                                  ("area", "contains", "A")])).collect()
    assert [r["incident_id"] for r in hot] == [2]
    with pytest.raises(ValueError):
        details.table_filter([("area", "like", "A")])


# Q13 + W3: frequency over the shown points only; flat size when all equal.
def test_map_points(make_incidents):
    df = make_incidents([
        _row(1, D(2023, 1, 3), lat=47.60001, lon=-122.3),
        _row(2, D(2023, 1, 2), lat=47.60002, lon=-122.3),
        _row(3, D(2023, 1, 1), lat=47.7, lon=-122.3),
    ])
    pts = {r["incident_id"]: r for r in mapping.map_points(df, IncidentFilter(), n=2).collect()}
    assert set(pts) == {1, 2}
    assert pts[1]["location_freq"] == 2 and pts[1]["marker_size"] == 8.0
    allp = {r["incident_id"]: r for r in mapping.map_points(df, IncidentFilter(), n=3).collect()}
    assert allp[1]["marker_size"] == 25.0 and allp[3]["marker_size"] == 5.0
    st = mapping.map_stats(df, IncidentFilter(), n=2).first()
    assert (st["points"], st["shown_total"], st["matching_total"]) == (2, 2, 3)


# circle test with default radius; null coordinates never match.
def test_circle(make_incidents):
    df = make_incidents([_row(1, lat=47.6062, lon=-122.3321), _row(2, lat=47.6130, lon=-122.3321),
                         _row(3, lat=None)])
    assert ids(IncidentFilter(circle=Circle(47.6062, -122.3321)).apply(df)) == [1, 2]
    assert ids(IncidentFilter(circle=Circle(47.6062, -122.3321, 500)).apply(df)) == [1]


# A15 + P7 + Q15: labels with default; fallback to the three names; sampling.
def test_options(make_incidents):
    df = make_incidents([_row(1, cat="PERSON"), _row(2, cat="OTHER"), _row(3, cat="NOT_A_CRIME")])
    got = {r["category"]: r["label"] for r in options.category_options(df).collect()}
    assert got == {"PERSON": "Person", "OTHER": "OTHER", "NOT_A_CRIME": "Not a Crime"}
    none = make_incidents([_row(1, cat=None)])
    assert [r["category"] for r in options.category_options(none).collect()] == ["PERSON", "PROPERTY", "SOCIETY"]


# Q16: bad arguments raise.
def test_bad_metric(make_incidents):
    with pytest.raises(ValueError):
        trends.area_trends(make_incidents([_row(1)]), metric="mean")


# K2 + G3: stored geocoder replies; address keys append the city when missing.
def test_geocoder_reply_and_keys(spark):
    from incident_analytics.functions.text import address_key
    from incident_analytics.operators.geocode import parse_geocoder_reply
    df = spark.createDataFrame([
        ('[{"lat": "47.6", "lon": "-122.3", "display_name": "Pike St"}, {"lat": "1", "lon": "2"}]', "1st  Ave"),
        ("[]", "1st Ave, SEATTLE"),
        ("not json", None),
    ], "reply STRING, address STRING")
    out = df.select(parse_geocoder_reply(F.col("reply")).alias("r"), address_key(F.col("address")).alias("k")).collect()
    assert (out[0]["r"]["lat"], out[0]["r"]["lon"], out[0]["r"]["display_name"]) == (47.6, -122.3, "Pike St")
    assert out[1]["r"]["lat"] is None and out[2]["r"]["lat"] is None
    assert out[0]["k"] == "1st ave, seattle, wa" and out[1]["k"] == "1st ave, seattle" and out[2]["k"] is None


# Q5: zero-count labels only on request.
def test_include_empty(make_incidents):
    df = make_incidents([_row(1, cat="PERSON", sub="P_1"), _row(2, cat="SOCIETY", sub="S_1"),
                         _row(3, D(2023, 7, 2), area="LATE")])
    plain = breakdown.subcategory_breakdown(df, "SOCIETY").collect()
    assert [(r["offense_sub_category"], r["incidents"]) for r in plain] == [("S_1", 1)]
    full = breakdown.subcategory_breakdown(df, "SOCIETY", include_empty=True).collect()
    assert [(r["offense_sub_category"], r["incidents"]) for r in full] == [("S_1", 1), ("P_1", 0)]
    # area LATE has rows only after the cut: ranked (bottom) only with include_empty
    bottom = trends.area_trends(df, order="bottom", n=1, as_of="2023-07-15", include_empty=True)
    assert bottom.count() == 0
    bottom = trends.area_trends(df, order="bottom", n=1, as_of="2023-07-15")
    assert [r["area"] for r in bottom.collect()] == ["A"]
    hz = trends.area_trends(df, metric="hazard", order="top", n=2, as_of="2023-07-15", include_empty=True)
    assert [r["area"] for r in hz.collect()] == ["A"]
