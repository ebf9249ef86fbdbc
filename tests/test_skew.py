"""Hot keys: one area / location / cell holding a third or more of all rows.

Results must stay exact and whole, and the plans must combine partially
before any shuffle (a hot key costs one row per task, not a third of the table
in one task).
"""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from incident_analytics import IncidentFilter
from incident_analytics.operators import breakdown, kpi, spatial_join, trends
from incident_analytics.plans import plan_text
from incident_analytics.schema import INCIDENTS

N = 6000


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(N):
        hot = i % 2 == 0  # half of all rows on one area, one day, one spot
        rows.append((i, dt.date(2023, 5, 1) if hot else dt.date(2023, 1, 1) + dt.timedelta(days=rnd.randrange(300)),
                     "10:00:00", 10, None, "X", "S_HOT" if hot else f"S_{rnd.randrange(30)}",
                     "PERSON" if hot else rnd.choice(["PERSON", "PROPERTY", "SOCIETY"]),
                     "1XX BLOCK", "HOT" if hot else f"A_{rnd.randrange(40)}", "P", "S",
                     1.0 if hot else float(rnd.randrange(100)) / 4,
                     47.6062 if hot else rnd.uniform(47.5, 47.7),
                     -122.3321 if hot else rnd.uniform(-122.42, -122.25)))
    return spark.createDataFrame(rows, INCIDENTS).repartition(8)


def test_trend_exact_under_skew(skewed):
    out = {(r["period"], r["area"]): r["value"]
           for r in trends.area_trends(skewed, n=3, as_of="2024-01-01").collect()}
    # monthly buckets (span ~300 days); every HOT row is in May
    assert out[(dt.date(2023, 5, 1), "HOT")] == N // 2
    total_hot = skewed.where((F.col("area") == "HOT")).count()
    assert sum(v for (p, a), v in out.items() if a == "HOT") == total_hot


def test_breakdown_and_kpis_under_skew(skewed):
    kp = kpi.kpis(skewed).first()
    assert kp["total"] == N and kp["person"] >= N // 2
    top = breakdown.category_breakdown(skewed).where(F.col("rank") == 1).collect()
    person = [r for r in top if r["crime_against_category"] == "PERSON"][0]
    assert (person["offense_sub_category"], person["incidents"]) == ("S_HOT", N // 2)


def test_partial_aggregation_before_shuffle(skewed):
    for df in (kpi.kpis(skewed), breakdown.subcategory_counts(skewed),
               trends.daily_area_totals(skewed, as_of="2024-01-01")):
        plan = plan_text(df)
        # map-side partial aggregate (count or sum of counts) below the exchange
        assert ("partial_count" in plan or "partial_sum" in plan) and "Exchange" in plan


def _haversine(lat1, lon1, lat2, lon2):
    r1, n1, r2, n2 = map(math.radians, (lat1, lon1, lat2, lon2))
    a = math.sin((r2 - r1) / 2) ** 2 + math.cos(r1) * math.cos(r2) * math.sin((n2 - n1) / 2) ** 2
    return 2 * math.asin(math.sqrt(a)) * 6371000


def test_radius_join_hot_cell(spark, skewed):
    centers = [(1, 47.6062, -122.3321, 805.0), (2, 47.61, -122.33, 300.0), (3, 47.55, -122.40, 805.0)]
    cdf = spark.createDataFrame(centers, "center_id INT, center_lat DOUBLE, center_lon DOUBLE, radius_m DOUBLE")
    got = {r["center_id"]: r["n"] for r in spatial_join.radius_join(
        IncidentFilter().apply(skewed), cdf).groupBy("center_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    pts = [(r["latitude"], r["longitude"]) for r in skewed.select("latitude", "longitude").collect()]
    want = {c: sum(1 for a, b in pts if _haversine(la, lo, a, b) <= r) for c, la, lo, r in centers}
    assert got == {c: n for c, n in want.items() if n}


def _largest_and_median(df, keys, parts):
    """Rows of the largest and the median shuffle partition of ``df`` dealt by ``keys``."""
    counts = [r["count"] for r in df.repartition(parts, *keys).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    counts = sorted([0] * (parts - len(counts)) + counts)
    return counts[-1], counts[parts // 2]


def test_hot_cell_is_split(spark, skewed):
    """Half of all incidents in one cell: no task gets three times the median, and the pairs are the same."""
    r = random.Random(8)
    rows = [(i, r.uniform(47.5, 47.7), r.uniform(-122.42, -122.25), r.choice([50.0, 805.0, 2000.0])) for i in range(60)]
    rows += [(60 + i, 47.6062, -122.3321, 100.0) for i in range(3)]
    centers = spark.createDataFrame(rows, "center_id INT, center_lat DOUBLE, center_lon DOUBLE, radius_m DOUBLE")
    pts = IncidentFilter().apply(skewed).select("incident_id", "latitude", "longitude")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        cells = spatial_join.circle_cells(centers)
        points = spatial_join.point_cells(pts, cells)
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert spatial_join.hot_cells(points).count() < spatial_join.PIECES * parts
        dealt, repeated = spatial_join.split_hot_cells(points, cells)
        whole, _ = _largest_and_median(points, spatial_join.CELL, parts)
        most, median = _largest_and_median(dealt, [*spatial_join.CELL, "_piece"], parts)
        assert most < 3 * median and most < whole
        assert dealt.count() == points.count() and repeated.count() > cells.count()
        pairs = [sorted(spatial_join.radius_join(pts, centers, split=s).select("center_id", "incident_id").collect())
                 for s in (True, False)]
        assert pairs[0] == pairs[1]
        want = sorted((c, p["incident_id"]) for p in pts.collect() for c, la, lo, m in rows
                      if _haversine(la, lo, p["latitude"], p["longitude"]) <= m)
        assert [tuple(x) for x in pairs[0]] == want
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
