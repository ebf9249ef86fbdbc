"""Cells of many-edge polygons: equal to the full ring test, with few edges a candidate."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from incident_analytics.functions import geo
from incident_analytics.operators import spatial_join


def star(edges, lat, lon, size, seed):
    """A jagged ring around a place, closed by its first point."""
    r = random.Random(seed)
    ring = [[lon + size * (0.7 + 0.3 * r.random()) * math.cos(2 * math.pi * k / edges),
             lat + size * (0.7 + 0.3 * r.random()) * math.sin(2 * math.pi * k / edges)] for k in range(edges)]
    return json.dumps({"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[*ring, ring[0]]]}})


SQUARE = json.dumps({"type": "Polygon", "coordinates": [[[-122.5, 47.5], [-122.25, 47.5], [-122.25, 47.75], [-122.5, 47.75], [-122.5, 47.5]]]})
BOW = json.dumps({"type": "Polygon", "coordinates": [[[-122.5, 47.5], [-122.0, 47.9], [-122.0, 47.5], [-122.5, 47.9]]]})
EMPTY = json.dumps({"type": "Polygon", "coordinates": [[]]})


@pytest.fixture(scope="module")
def shapes(spark):
    rows = [("star20", star(20, 47.6, -122.3, 0.2, 1)), ("star2000", star(2000, 47.6, -122.3, 0.2, 2)),
            ("tiny", star(300, 47.61, -122.31, 0.001, 3)), ("square", SQUARE), ("bow", BOW), ("empty", EMPTY), ("null", None),
            ("equator", star(500, 0.0, 0.0, 3.0, 4))]
    return spark.createDataFrame(rows, "name STRING, geojson STRING").cache()


@pytest.fixture(scope="module")
def points(spark, shapes):
    r = random.Random(5)
    places = [(47.6 + r.uniform(-0.3, 0.3), -122.3 + r.uniform(-0.3, 0.3)) for _ in range(1500)]
    places += [(47.61 + r.uniform(-0.002, 0.002), -122.31 + r.uniform(-0.002, 0.002)) for _ in range(300)]
    places += [(r.uniform(-4, 4), r.uniform(-4, 4)) for _ in range(300)]
    # on vertices, edges, and borders of cells
    places += [(47.5, -122.5), (47.75, -122.25), (47.5, -122.3), (47.75, -122.3), (47.6, -122.5), (47.6, -122.25), (0.0, 0.0)]
    places += [(p["lat"], p["lon"]) for row in shapes.select(geo.ring_column(F.col("geojson")).alias("r")).collect()
               for p in (row["r"] or [])[:100]]
    places += [(None, -122.3), (47.6, None)]
    return spark.createDataFrame([(i, *p) for i, p in enumerate(places)],
                                 "incident_id INT, latitude DOUBLE, longitude DOUBLE").cache()


def inside(ring, lat, lon):
    """Plain count of crossed edges, and the closed box."""
    if not ring or not (min(y for _, y in ring) <= lat <= max(y for _, y in ring) and min(x for x, _ in ring) <= lon <= max(x for x, _ in ring)):
        return False
    odd = False
    for k, (bx, by) in enumerate(ring):
        ax, ay = ring[k - 1]
        if min(ay, by) < lat <= max(ay, by) and lon <= max(ax, bx) and (ax == bx or lon <= (lat - ay) * (bx - ax) / (by - ay) + ax):
            odd = not odd
    return odd


def test_join_equals_brute_force(shapes, points):
    got = sorted((r["name"], r["incident_id"]) for r in spatial_join.polygon_join(points, shapes).select("name", "incident_id").collect())
    want = []
    for s in shapes.where("geojson IS NOT NULL").collect():
        shape = json.loads(s["geojson"])
        ring = shape.get("geometry", shape)["coordinates"][0]
        want += [(s["name"], p["incident_id"]) for p in points.dropna().collect() if inside(ring, p["latitude"], p["longitude"])]
    assert got == sorted(want)
    assert {"star20", "star2000", "tiny", "square", "bow", "equator"} == {n for n, _ in got}


def test_candidates_carry_few_edges(shapes, points):
    cells = spatial_join.polygon_cells(shapes)
    per = {r["name"]: r for r in cells.groupBy("name").agg(
        F.count("*").alias("cells"), F.max(F.size("_edges")).alias("edges"), F.sum(F.col("_whole").cast("int")).alias("whole")).collect()}
    assert per["star2000"]["edges"] < 2000 / 4 and per["star2000"]["whole"] > 0
    assert per["star2000"]["cells"] <= (spatial_join.MOST_CELLS + 1) ** 2
    assert per["square"]["cells"] <= 25
    # edges tested over all candidates: 100 times the edges cost at most 10 times as many tests
    tests = {r["name"]: r["n"] for r in spatial_join.candidates(points, cells).groupBy("name").agg(F.sum(F.size("_edges")).alias("n")).collect()}
    assert tests["star2000"] < 10 * tests["star20"]
