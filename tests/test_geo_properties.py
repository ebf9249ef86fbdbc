"""Spatial functions against plain-Python brute force, and set properties."""

from __future__ import annotations

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from incident_analytics import IncidentFilter
from incident_analytics.functions import geo
from incident_analytics.operators import spatial_join

import query_params as P

RINGS = {
    "rectangle": [[-122.40, 47.55], [-122.30, 47.55], [-122.30, 47.65], [-122.40, 47.65]],
    "u_shape": geo.ring_from_geojson(P.POLYGON_U),
    "triangle": [[-122.30, 47.55], [-122.24, 47.71], [-122.41, 47.66]],
    "closed_diamond": [[-122.33, 47.53], [-122.27, 47.61], [-122.33, 47.69], [-122.39, 47.61], [-122.33, 47.53]],
}


def ray_cast(lat, lon, ring):
    """Odd number of edges that reach the point's latitude (upper end included) and
    pass at or right of it there; the rule is one of doubles, so this is too."""
    def right_of(a, b):
        (ax, ay), (bx, by) = a, b
        if not min(ay, by) < lat <= max(ay, by):
            return False
        return lon <= max(ax, bx) and (ax == bx or lon <= (lat - ay) * (bx - ax) / (by - ay) + ax)

    return sum(right_of(a, b) for a, b in zip(ring, ring[1:] + ring[:1])) % 2 == 1


def haversine(lat1, lon1, lat2, lon2):
    rl1, rn1, rl2, rn2 = map(math.radians, (lat1, lon1, lat2, lon2))
    a = math.sin((rl2 - rl1) / 2) ** 2 + math.cos(rl1) * math.cos(rl2) * math.sin((rn2 - rn1) / 2) ** 2
    return 2 * math.asin(math.sqrt(a)) * 6371000


def _points(seed, n=3000):
    rnd = random.Random(seed)
    pts = [(i, rnd.uniform(47.45, 47.75), rnd.uniform(-122.45, -122.20)) for i in range(n)]
    # vertices and edge midpoints of every ring: the edge rule matters there
    k = n
    for ring in RINGS.values():
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            pts.append((k, y1, x1))
            pts.append((k + 1, (y1 + y2) / 2, (x1 + x2) / 2))
            k += 2
    return pts


@pytest.fixture(scope="module")
def points(spark):
    pts = _points(7)
    return pts, spark.createDataFrame(pts, "incident_id BIGINT, latitude DOUBLE, longitude DOUBLE")


@pytest.mark.parametrize("name", sorted(RINGS))
def test_point_in_ring_matches_loop(points, name):
    pts, df = points
    ring = RINGS[name]
    got = {r["incident_id"] for r in df.where(geo.point_in_ring("latitude", "longitude", ring)).collect()}
    want = {i for i, lat, lon in pts if ray_cast(lat, lon, ring)}
    assert got == want


@pytest.mark.parametrize("name", sorted(RINGS))
def test_ring_column_matches_literal(spark, points, name):
    _, df = points
    ring = RINGS[name]
    gj = '{"type": "Polygon", "coordinates": [[' + ", ".join(f"[{x!r}, {y!r}]" for x, y in ring) + "]]}"
    lit = {r["incident_id"] for r in df.where(geo.point_in_ring("latitude", "longitude", ring)).collect()}
    col = df.withColumn("ring", geo.ring_column(F.lit(gj)))
    got = {r["incident_id"] for r in col.where(geo.point_in_ring_column(
        F.col("latitude"), F.col("longitude"), F.col("ring"))).collect()}
    assert got == lit


def test_polygon_filter_on_rectangle_is_its_box(points):
    _, df = points
    ring = RINGS["rectangle"]
    inside = {r["incident_id"] for r in df.where(geo.in_polygon("latitude", "longitude", ring)).collect()}
    box = {r["incident_id"] for r in df.where(
        (F.col("latitude") > 47.55) & (F.col("latitude") <= 47.65)
        & (F.col("longitude") >= -122.40) & (F.col("longitude") <= -122.30)).collect()}
    # parity: bottom edge open, top closed; left edge closed and right edge closed on x <= max
    assert inside <= box and len(box - inside) <= 4


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(lat=st.floats(47.45, 47.75), lon=st.floats(-122.45, -122.20), r=st.sampled_from([161.0, 805.0, 3219.0]))
def test_circle_box_is_superset_and_haversine_agrees(points, lat, lon, r):
    pts, df = points
    got = {row["incident_id"] for row in df.where(geo.within_radius("latitude", "longitude", lat, lon, r)).collect()}
    want = {i for i, a, b in pts if haversine(lat, lon, a, b) <= r}
    # ulp-level differences between JVM and C maths may only matter on the circle itself
    diff = got ^ want
    assert all(abs(haversine(lat, lon, a, b) - r) < 1e-6 for i, a, b in pts if i in diff)
    lo_lat, hi_lat, lo_lon, hi_lon = geo.circle_box(lat, lon, r)
    assert all(lo_lat <= a <= hi_lat and lo_lon <= b <= hi_lon for i, a, b in pts if i in want)


def test_radius_join_equals_brute_force(spark, points):
    pts, df = points
    centers = [(1, 47.6062, -122.3321, 805.0), (2, 47.55, -122.40, 3219.0), (3, 47.70, -122.25, 161.0)]
    cdf = spark.createDataFrame(centers, "center_id INT, center_lat DOUBLE, center_lon DOUBLE, radius_m DOUBLE")
    got = {(r["center_id"], r["incident_id"]) for r in spatial_join.radius_join(df, cdf).collect()}
    want = {(c, i) for c, clat, clon, r in centers for i, a, b in pts if haversine(clat, clon, a, b) <= r}
    diff = got ^ want
    assert len(diff) <= 1 and len(got) > 0


def test_polygon_join_equals_filter(spark, points):
    _, df = points
    polys = [(i, P.POLYGONS[i - 1][1]) for i in range(1, 5)]
    pdf = spark.createDataFrame(polys, "polygon_id INT, geojson STRING")
    got = {(r["polygon_id"], r["incident_id"]) for r in spatial_join.polygon_join(df, pdf).collect()}
    want = set()
    for pid, gj in polys:
        want |= {(pid, r["incident_id"]) for r in IncidentFilter(polygon=gj).apply(df.withColumn(
            "date", F.lit(None).cast("date"))).collect()}
    assert got == want


def test_outline_closes(spark):
    df = spark.createDataFrame([(47.6, -122.3, 805.0)], "latitude DOUBLE, longitude DOUBLE, radius_m DOUBLE")
    from incident_analytics.operators.geocode import circle_outlines
    pts = circle_outlines(df).orderBy("point").collect()
    assert len(pts) == 65
    assert pts[0]["latitude"] == pytest.approx(pts[-1]["latitude"]) and pts[0]["radius_miles"] == pytest.approx(805 / 1609.34)
    assert pts[0]["latitude"] == pytest.approx(47.6 + 805 / 111000)


def test_circles_across_the_antimeridian(spark):
    pts = [(1, 10.0, 179.999), (2, 10.0, -179.999), (3, 10.0, -179.9), (4, 10.0, 179.9)]
    df = spark.createDataFrame(pts, "incident_id BIGINT, latitude DOUBLE, longitude DOUBLE")
    for lon in (179.9995, -179.9995):
        near = {r["incident_id"] for r in df.where(geo.within_radius("latitude", "longitude", 10.0, lon, 500)).collect()}
        assert near == {1, 2}
        cdf = spark.createDataFrame([(1, 10.0, lon, 500.0)],
                                    "center_id INT, center_lat DOUBLE, center_lon DOUBLE, radius_m DOUBLE")
        got = {r["incident_id"] for r in spatial_join.radius_join(df, cdf).collect()}
        assert got == {1, 2}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(lat=st.floats(-89.0, 89.0), lon=st.floats(-180.0, 180.0),
       r=st.sampled_from([100.0, 805.0, 5000.0, 50000.0]), seed=st.integers(0, 10_000))
def test_circle_anywhere_on_earth(spark, lat, lon, r, seed):
    """The box in front of the exact test never drops a point of the circle,
    near the poles and across ±180° included."""
    rnd = random.Random(seed)
    spread = math.degrees(3 * r / 6371000)
    pts = []
    for i in range(300):
        a = max(-90.0, min(90.0, lat + rnd.uniform(-spread, spread)))
        b = lon + rnd.uniform(-spread, spread) / max(math.cos(math.radians(lat)), 0.05)
        b = (b + 180.0) % 360.0 - 180.0
        pts.append((i, a, b))
    df = spark.createDataFrame(pts, "incident_id BIGINT, latitude DOUBLE, longitude DOUBLE")
    got = {row["incident_id"] for row in df.where(geo.within_radius("latitude", "longitude", lat, lon, r)).collect()}
    want = {i for i, a, b in pts if haversine(lat, lon, a, b) <= r}
    diff = got ^ want
    assert all(abs(haversine(lat, lon, a, b) - r) < 1e-6 * max(r, 1) for i, a, b in pts if i in diff)
    cdf = spark.createDataFrame([(1, lat, lon, r)], "center_id INT, center_lat DOUBLE, center_lon DOUBLE, radius_m DOUBLE")
    joined = {row["incident_id"] for row in spatial_join.radius_join(df, cdf).collect()}
    diff = joined ^ want
    assert all(abs(haversine(lat, lon, a, b) - r) < 1e-6 * max(r, 1) for i, a, b in pts if i in diff)


def test_shapes_of_all_sizes_share_a_join(spark):
    """One large shape neither widens the search of small ones nor explodes into many cells."""
    points = spark.range(40_000).select(
        F.col("id").alias("incident_id"), (47.5 + (F.col("id") * 7919 % 20_011) * 1e-5).alias("latitude"),
        (-122.4 + (F.col("id") * 104_729 % 20_021) * 1e-5).alias("longitude"))
    circles = [(i, 47.5 + 0.004 * i, -122.4 + 0.004 * i, 161.0) for i in range(50)] + [(99, 47.6, -122.3, 30_000.0)]
    centers = spark.createDataFrame(circles, "center_id INT, center_lat DOUBLE, center_lon DOUBLE, radius_m DOUBLE")
    cells = spatial_join.circle_cells(centers)
    assert cells.groupBy("center_id").count().agg(F.max("count")).first()[0] <= 9
    pairs = spatial_join.radius_join(points, centers)
    small = F.col("center_id") < 99
    assert pairs.where(~small).count() == 40_000
    assert spatial_join.candidates(points, cells).where(small).count() <= 20 * pairs.where(small).count()
    boxes = [(i, f'{{"type": "Polygon", "coordinates": [[[{x}, {y}], [{x + s}, {y}], [{x + s}, {y + s}], [{x}, {y + s}]]]}}')
             for i, (x, y, s) in enumerate([(-122.35, 47.55, 0.002), (-122.31, 47.61, 0.002), (-123.0, 47.0, 1.0), (-127.0, 42.0, 10.0)])]
    polygons = spark.createDataFrame(boxes, "polygon_id INT, geojson STRING")
    cells = spatial_join.polygon_cells(polygons)
    assert cells.groupBy("polygon_id").count().agg(F.max("count")).first()[0] <= 25
    counts = {r["polygon_id"]: r["count"] for r in spatial_join.polygon_join(points, polygons).groupBy("polygon_id").count().collect()}
    assert counts[2] == counts[3] == 40_000
    assert spatial_join.candidates(points, cells).where("polygon_id < 2").count() <= 20 * max(1, counts.get(0, 0) + counts.get(1, 0))
