"""Spatial joins without cross joins: incidents × many circles, × many polygons.

Both use a lat/lon grid of several levels; a cell of level L has an edge of
2**L degrees. Each circle or polygon takes the level at which its own bounding
box spans a few cells and is exploded (a generator, not a join) into the cells
its box touches: at most 9 for a circle and 25 for a polygon of up to 16 points
(twice that across the ±180° meridian), whatever the sizes of the other shapes.
A polygon of many edges takes finer cells, about as many as it has edges. Cells
that no edge comes near are wholly inside, where a point needs no further test,
or outside, and left out; the others carry only the edges that their points can
cross, so the cost of a candidate does not grow with the polygon's edges. Each
incident emits one row per level in use (levels differ by a factor of two, so
29 cover 0.1 m to the globe). The equi-join on (level, cell_y, cell_x) yields
candidate pairs, and the exact test (haversine, ray-casting parity) keeps the
true ones. Every true pair is found once: a shape has one level, and an
incident one cell of that level.

Scale: a shape's candidates are the incidents in a box a few times its own
area, so one large shape does not widen the search of small ones. The exploded
shape side is small and is broadcast by Spark's own size check when it fits;
otherwise it is a shuffle join on the cell, where AQE splits a hot cell (a
third of all incidents in one cell) into several tasks. ``split`` does so
without AQE: a cell that holds too many incidents is counted beforehand, its
incidents are dealt over pieces by a hash of the whole row, and the cell's
shapes are repeated once a piece.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..plans.materialize import materialize

FINEST, COARSEST = -20, 8  # cell edges of about 0.1 m and 256 degrees
MOST_CELLS = 64  # a side, for polygons of very many edges
MARGIN = 1e-9    # degrees; far more than the rounding of an edge's intercept
CELL = ["_level", "_cell_y", "_cell_x"]
PIECES = 4       # of incidents per shuffle partition, at most, where cells are split


def _level(side: Column, cells: int | Column) -> Column:
    """Level whose cell edge is at least ``side / cells`` and less than twice that."""
    wanted = F.ceil(F.log2(F.greatest(side, F.lit(1e-9)) / cells))
    return F.least(F.greatest(wanted, F.lit(FINEST)), F.lit(COARSEST)).cast("int")


def _cell(x: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), F.col("_level"))).cast("bigint")


def _explode_box(df: DataFrame, lo_lat, hi_lat, lo_lon, hi_lon) -> DataFrame:
    ys = F.sequence(_cell(lo_lat), _cell(hi_lat))
    # longitude cells, with the part of a box past ±180° wrapped to the other side
    none = F.array().cast("array<bigint>")
    xs = F.concat(
        F.sequence(_cell(F.greatest(lo_lon, F.lit(-180.0))), _cell(F.least(hi_lon, F.lit(180.0)))),
        F.when(lo_lon < -180.0, F.sequence(_cell(lo_lon + 360.0), _cell(F.lit(180.0)))).otherwise(none),
        F.when(hi_lon > 180.0, F.sequence(_cell(F.lit(-180.0)), _cell(hi_lon - 360.0))).otherwise(none),
    )
    return (df.withColumn("_cell_y", F.explode(ys))
              .withColumn("_cell_x", F.explode(F.array_distinct(xs))))


def circle_cells(centers: DataFrame, center_lat: str = "center_lat", center_lon: str = "center_lon",
                 radius: str = "radius_m") -> DataFrame:
    """One row per circle and cell of the circle's level that its box touches."""
    lat, lon = F.col(center_lat), F.col(center_lon)
    dlat, dlon = geo.circle_box_columns(lat, F.col(radius))
    leveled = centers.withColumn("_level", _level(2 * F.greatest(dlat, dlon), 2))
    return _explode_box(leveled, lat - dlat, lat + dlat, lon - dlon, lon + dlon)


def polygon_cells(polygons: DataFrame, geojson: str = "geojson") -> DataFrame:
    """One row per polygon and cell of its level that it can reach, with the box,
    ``_whole`` (no edge comes near the cell, which lies inside) and ``_edges``
    (for other cells: those edges that a point of the cell can cross). Cells that
    no edge comes near and that lie outside are left out. The more edges, the
    finer the cells: about the square root of their number a side, 4 to
    ``MOST_CELLS``."""
    ring = geo.ring_column(F.col(geojson))
    lo_lat, hi_lat, lo_lon, hi_lon = geo.ring_bounds_columns(F.col("_ring"))
    shapes = (polygons.withColumn("_ring", ring)
                      .withColumn("_lo_lat", lo_lat).withColumn("_hi_lat", hi_lat)
                      .withColumn("_lo_lon", lo_lon).withColumn("_hi_lon", hi_lon))
    side = F.greatest(F.col("_hi_lat") - F.col("_lo_lat"), F.col("_hi_lon") - F.col("_lo_lon"))
    fine = F.least(F.greatest(F.ceil(F.sqrt(F.size("_ring"))), F.lit(4)), F.lit(MOST_CELLS))
    cells = _explode_box(shapes.withColumn("_level", _level(side, fine)),
                         F.col("_lo_lat"), F.col("_hi_lat"), F.col("_lo_lon"), F.col("_hi_lon"))
    edge = F.pow(F.lit(2.0), F.col("_level"))
    y, x = F.col("_cell_y") * edge, F.col("_cell_x") * edge

    def ends(p: Column, q: Column) -> tuple[Column, Column]:
        return F.least(p, q), F.greatest(p, q)

    def near(p: Column, q: Column) -> Column:
        (low_y, high_y), (low_x, high_x) = ends(p["lat"], q["lat"]), ends(p["lon"], q["lon"])
        return ((high_y >= y - MARGIN) & (low_y <= y + edge + MARGIN)
                & (high_x >= x - MARGIN) & (low_x <= x + edge + MARGIN))

    def reached(e: Column) -> Column:
        (low_y, high_y), (_, high_x) = ends(e["y1"], e["y2"]), ends(e["x1"], e["x2"])
        return (high_y >= y) & (low_y < y + edge) & (high_x >= x)

    # level edges bound the polygon too
    following = F.concat(F.slice("_ring", F.lit(2), F.greatest(F.size("_ring") - 1, F.lit(0))), F.slice("_ring", 1, 1))
    touched = F.exists(F.zip_with("_ring", following, near), lambda hit: F.coalesce(hit, F.lit(False)))
    centre_inside = geo.point_in_ring_column(y + edge / 2, x + edge / 2, F.col("_ring"))
    none = F.filter(geo.ring_edges_column(F.col("_ring")), lambda e: F.lit(False))
    return (cells.withColumn("_touched", touched)
                 .withColumn("_whole", F.when(F.col("_touched"), F.lit(False)).otherwise(centre_inside))
                 .where(F.col("_touched") | F.col("_whole"))
                 .withColumn("_edges", F.when(F.col("_touched"), F.filter(geo.ring_edges_column(F.col("_ring")), reached)).otherwise(none))
                 .drop("_ring", "_touched"))


def point_cells(incidents: DataFrame, cells: DataFrame) -> DataFrame:
    """One row per incident with coordinates and level in use, with its cell."""
    levels = cells.agg(F.collect_set("_level")).scalar()  # at most one entry per level
    lat, lon = F.col("latitude"), F.col("longitude")
    return (incidents.where(lat.isNotNull() & lon.isNotNull()).withColumn("_level", F.explode(levels))
            .withColumn("_cell_y", _cell(lat)).withColumn("_cell_x", _cell(lon)))


def hot_cells(points: DataFrame) -> DataFrame:
    """(cell, _pieces): the cells that hold more than one in ``PIECES`` times the
    shuffle partitions of all rows of ``points``, and into how many pieces of
    that size to split them. Fewer rows than that number, whatever the data."""
    most = PIECES * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = points.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_n"))
    share = counts.agg(F.sum("_n")).scalar() / F.lit(most)
    hot = counts.where(F.col("_n") > share)
    return materialize(hot.select(*CELL, F.ceil(F.col("_n") / share).cast("int").alias("_pieces")))


def split_hot_cells(points: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``_piece`` to join on besides the cell. The incidents of
    a hot cell are dealt by a hash of all their columns, so a task that is run
    again deals them alike (rows equal in every column share a piece); the
    cell's shapes are repeated in each piece. Other cells have one piece."""
    columns = [F.col(f"`{c}`") for c in points.columns]
    hot = F.broadcast(hot_cells(points))  # bounded, see hot_cells
    pieces = F.coalesce("_pieces", F.lit(1))
    dealt = points.join(hot, CELL, "left").withColumn("_piece", F.pmod(F.xxhash64(*columns), pieces).cast("int"))
    repeated = cells.join(hot, CELL, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    return dealt.drop("_pieces"), repeated.drop("_pieces")


def candidates(incidents: DataFrame, cells: DataFrame, split: bool = False) -> DataFrame:
    """Incidents joined with the shapes whose cells hold them, before the exact
    test. ``split``: hot cells are counted (one more pass over the incidents) and
    split, for shapes too many to broadcast."""
    points = point_cells(incidents, cells)
    if split:
        points, cells = split_hot_cells(points, cells)
        return points.join(cells, [*CELL, "_piece"], "inner").drop(*CELL, "_piece")
    return points.join(cells, CELL, "inner").drop(*CELL)


def radius_join(incidents: DataFrame, centers: DataFrame, center_lat: str = "center_lat",
                center_lon: str = "center_lon", radius: str = "radius_m", split: bool = False) -> DataFrame:
    """Pairs (centre columns…, incident columns…, distance_m) with the incident
    within the centre's radius (great-circle, metres). ``split``: see ``candidates``."""
    pairs = candidates(incidents, circle_cells(centers, center_lat, center_lon, radius), split)
    dist = geo.haversine_m(F.col(center_lat), F.col(center_lon), F.col("latitude"), F.col("longitude"))
    return pairs.withColumn("distance_m", dist).where(F.col("distance_m") <= F.col(radius))


def polygon_join(incidents: DataFrame, polygons: DataFrame, geojson: str = "geojson",
                 split: bool = False) -> DataFrame:
    """Pairs (polygon columns…, incident columns…) with the incident inside the
    polygon's outer ring (closed bounding box and ray-casting parity). ``split``:
    see ``candidates``."""
    pairs = candidates(incidents, polygon_cells(polygons, geojson), split)
    lat, lon = F.col("latitude"), F.col("longitude")
    inside = (lat.between(F.col("_lo_lat"), F.col("_hi_lat")) & lon.between(F.col("_lo_lon"), F.col("_hi_lon"))
              & (F.col("_whole") | geo.odd_crossings(lat, lon, F.col("_edges"))))
    return pairs.where(inside).drop("_edges", "_whole", "_lo_lat", "_hi_lat", "_lo_lon", "_hi_lon")
