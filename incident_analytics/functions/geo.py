"""Spatial Column functions. All stay in the JVM (no Python UDF).

Rings are GeoJSON outer rings: lists of ``[lon, lat]`` pairs. Holes are not
used, as in the dashboard.
"""

from __future__ import annotations

import json
import math
from functools import reduce
from operator import add
from typing import Sequence, Union

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Earth radius for great-circle distance, metres per degree used
# by the circle outline, metres per mile, default circle radius and the number
# of outline steps.
EARTH_RADIUS_M = 6371000.0
OUTLINE_M_PER_DEG = 111000.0
METRES_PER_MILE = 1609.34
DEFAULT_RADIUS_M = 805.0
OUTLINE_STEPS = 64

ColumnOrValue = Union[Column, str, float, int]
Ring = Sequence[Sequence[float]]

def _c(x: ColumnOrValue) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(float(x))


def haversine_m(lat1: ColumnOrValue, lon1: ColumnOrValue,
                lat2: ColumnOrValue, lon2: ColumnOrValue) -> Column:
    """Great-circle distance in metres; null when any input is null."""
    rlat1, rlon1 = F.radians(_c(lat1)), F.radians(_c(lon1))
    rlat2, rlon2 = F.radians(_c(lat2)), F.radians(_c(lon2))
    s_lat = F.sin((rlat2 - rlat1) / 2)
    s_lon = F.sin((rlon2 - rlon1) / 2)
    a = s_lat * s_lat + F.cos(rlat1) * F.cos(rlat2) * (s_lon * s_lon)
    return F.lit(2.0) * F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * F.lit(EARTH_RADIUS_M)


def circle_box(lat: float, lon: float, radius_m: float) -> tuple[float, float, float | None, float | None]:
    """A lat/lon box that contains every point within ``radius_m`` of the centre.

    Returns (min_lat, max_lat, min_lon, max_lon); the longitude bounds are None
    when the circle reaches a pole. A small outward margin keeps the box a
    true superset under rounding.
    """
    ang = radius_m / EARTH_RADIUS_M
    dlat = math.degrees(ang) * (1 + 1e-9) + 1e-9
    if abs(lat) + dlat >= 90.0:
        return lat - dlat, lat + dlat, None, None
    ratio = min(1.0, math.sin(ang) / math.cos(math.radians(lat)))
    dlon = math.degrees(math.asin(ratio)) * (1 + 1e-9) + 1e-9
    return lat - dlat, lat + dlat, lon - dlon, lon + dlon


def circle_box_columns(lat: Column, radius_m: Column) -> tuple[Column, Column]:
    """Half-height and half-width (degrees) of the box around each centre row."""
    ang = radius_m / F.lit(EARTH_RADIUS_M)
    dlat = F.degrees(ang) * F.lit(1 + 1e-9) + F.lit(1e-9)
    ratio = F.least(F.lit(1.0), F.sin(ang) / F.cos(F.radians(lat)))
    dlon = F.when(F.abs(lat) + dlat < 90.0, F.degrees(F.asin(ratio)) * F.lit(1 + 1e-9) + F.lit(1e-9)) \
        .otherwise(F.lit(180.0))
    return dlat, dlon


def within_radius(lat: ColumnOrValue, lon: ColumnOrValue,
                  center_lat: float, center_lon: float, radius_m: float | None = None) -> Column:
    """Circle test for one literal centre: bounding box (pushed to the scan),
    then exact haversine. Null coordinates give false."""
    radius = float(radius_m) if radius_m else DEFAULT_RADIUS_M
    lat_c, lon_c = _c(lat), _c(lon)
    lo_lat, hi_lat, lo_lon, hi_lon = circle_box(center_lat, center_lon, radius)
    # Top-level conjuncts so the box reaches the Parquet scan; the leading
    # null checks make the whole test false (never null) without coordinates.
    cond = lat_c.isNotNull() & lon_c.isNotNull() & (lat_c >= lo_lat) & (lat_c <= hi_lat)
    if lo_lon is not None:
        if lo_lon < -180.0:       # the box wraps across the antimeridian
            cond = cond & ((lon_c >= lo_lon + 360.0) | (lon_c <= hi_lon))
        elif hi_lon > 180.0:
            cond = cond & ((lon_c >= lo_lon) | (lon_c <= hi_lon - 360.0))
        else:
            cond = cond & (lon_c >= lo_lon) & (lon_c <= hi_lon)
    exact = haversine_m(F.lit(float(center_lat)), F.lit(float(center_lon)), lat_c, lon_c) <= radius
    return cond & exact


def ring_from_geojson(geojson: Union[str, dict, Ring]) -> list[list[float]]:
    """``geometry.coordinates[0]`` of a GeoJSON feature (or a ring as is)."""
    if isinstance(geojson, str):
        geojson = json.loads(geojson)
    if isinstance(geojson, dict):
        geom = geojson.get("geometry", geojson)
        return [[float(x), float(y)] for x, y in geom["coordinates"][0]]
    return [[float(x), float(y)] for x, y in geojson]


def ring_bounds(ring: Ring) -> tuple[float, float, float, float]:
    """(min_lat, max_lat, min_lon, max_lon) of a ring."""
    lats = [p[1] for p in ring]
    lons = [p[0] for p in ring]
    return min(lats), max(lats), min(lons), max(lons)


def _toggles(lat: Column, lon: Column, x1, y1, x2, y2, low_y, high_y, high_x, upright) -> Column:
    """Whether an edge is crossed: the latitude is above the edge's
    lower end and not above its upper end, and the longitude is at most the
    edge's larger one and, unless the edge is upright, at most its intercept at
    that latitude. A level edge has no such latitude."""
    at = F.try_divide((lat - y1) * (x2 - x1), y2 - y1) + x1
    return (lat > low_y) & (lat <= high_y) & (lon <= high_x) & (upright | (lon <= at))


def point_in_ring(lat: ColumnOrValue, lon: ColumnOrValue, ring: Ring) -> Column:
    """Ray-casting parity test against a literal ring, as one Column."""
    x, y = _c(lon), _c(lat)
    closed = [(float(px), float(py)) for px, py in [*ring, ring[0]]]
    crossed = [_toggles(y, x, *(F.lit(v) for v in (ax, ay, bx, by, min(ay, by), max(ay, by), max(ax, bx))), F.lit(ax == bx))
               for (ax, ay), (bx, by) in zip(closed, closed[1:], strict=False) if ay != by]
    if not crossed:
        return F.lit(False)
    return (reduce(add, [F.when(c, F.lit(1)).otherwise(F.lit(0)) for c in crossed]) % 2) == 1


def in_polygon(lat: ColumnOrValue, lon: ColumnOrValue, geojson: Union[str, dict, Ring]) -> Column:
    """Closed bounding box (pushed down) and exact parity; null coordinates → false."""
    ring = ring_from_geojson(geojson)
    lo_lat, hi_lat, lo_lon, hi_lon = ring_bounds(ring)
    lat_c, lon_c = _c(lat), _c(lon)
    box = (lat_c.isNotNull() & lon_c.isNotNull() & (lat_c >= lo_lat) & (lat_c <= hi_lat)
           & (lon_c >= lo_lon) & (lon_c <= hi_lon))
    return box & point_in_ring(lat_c, lon_c, ring)


def ring_column(geojson_col: Column) -> Column:
    """Parse a GeoJSON text column (a Feature or a bare Polygon geometry) to
    ``ARRAY<STRUCT<lon, lat>>`` (the outer ring)."""
    coords_t = T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))
    parsed = F.from_json(geojson_col, T.StructType([
        T.StructField("geometry", T.StructType([T.StructField("coordinates", coords_t)])),
        T.StructField("coordinates", coords_t),
    ]))
    outer = F.try_element_at(F.coalesce(parsed["geometry"]["coordinates"], parsed["coordinates"]), F.lit(1))
    return F.transform(outer, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))


def ring_edges_column(ring: Column) -> Column:
    """A ring column's edges, the closing one too, without level ones:
    ``ARRAY<STRUCT<x1, y1, x2, y2>>``."""
    following = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    edges = F.zip_with(ring, following, lambda p, q: F.struct(
        p["lon"].alias("x1"), p["lat"].alias("y1"), q["lon"].alias("x2"), q["lat"].alias("y2")))
    return F.filter(edges, lambda e: e["y1"] != e["y2"])


def odd_crossings(lat: Column, lon: Column, edges: Column) -> Column:
    """Parity of the edges of an edge column that are crossed, JVM-side by the
    ``aggregate`` higher-order function; no edges or a null column: false."""
    def step(acc: Column, e: Column) -> Column:
        hit = _toggles(lat, lon, e["x1"], e["y1"], e["x2"], e["y2"], F.least(e["y1"], e["y2"]),
                       F.greatest(e["y1"], e["y2"]), F.greatest(e["x1"], e["x2"]), e["x1"] == e["x2"])
        return acc + F.when(hit, F.lit(1)).otherwise(F.lit(0))

    return F.coalesce((F.aggregate(edges, F.lit(0), step) % 2) == 1, F.lit(False))


def point_in_ring_column(lat: Column, lon: Column, ring: Column) -> Column:
    """Parity test against a ring held in a column (one ring per row), by the
    same edge rule as :func:`point_in_ring`."""
    return odd_crossings(lat, lon, ring_edges_column(ring))


def ring_bounds_columns(ring: Column) -> tuple[Column, Column, Column, Column]:
    """(min_lat, max_lat, min_lon, max_lon) of a ring column."""
    lats = F.transform(ring, lambda p: p["lat"])
    lons = F.transform(ring, lambda p: p["lon"])
    return F.array_min(lats), F.array_max(lats), F.array_min(lons), F.array_max(lons)


def circle_outline(lat: Column, lon: Column, radius_m: Column, steps: int = OUTLINE_STEPS) -> Column:
    """Outline points ``ARRAY<STRUCT<i, lat, lon>>`` (steps + 1 points, closed),
    using the flat 111,000 m per degree approximation."""
    def point(i: Column) -> Column:
        angle = F.lit(2 * math.pi) * i / F.lit(steps)
        dlat = (radius_m / F.lit(OUTLINE_M_PER_DEG)) * F.cos(angle)
        dlon = (radius_m / (F.lit(OUTLINE_M_PER_DEG) * F.cos(F.radians(lat)))) * F.sin(angle)
        return F.struct(i.alias("i"), (lat + dlat).alias("lat"), (lon + dlon).alias("lon"))

    return F.transform(F.sequence(F.lit(0), F.lit(steps)), point)


def metres_to_miles(metres: ColumnOrValue) -> Column:
    return _c(metres) / F.lit(METRES_PER_MILE)
