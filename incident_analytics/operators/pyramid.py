"""Spatial summary: map answers without the row-level table.

One row per (level, cell, date, hour, category) with a count. A cell of level 0
is one 4-decimal location; a cell of level k spans 2**k such steps of latitude
and longitude, so each level is made from the one below by adding counts. Sizes
depend on places × hours × days, not on incidents; like the daily summary it is
mergeable: parts of several batches written side by side are simply summed.

It answers date, hour and category filters. Areas, polygons, circles and rows
(which 5,000 are shown) need the incidents themselves and raise. Rows without
coordinates are in no cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .filters import IncidentFilter
from .mapping import LOCATION_DECIMALS, MAP_POINTS

LEVELS = (0, 4, 8, 12)
STEPS = 10**LOCATION_DECIMALS
KEYS = ["level", "lat_cell", "lon_cell", "date", "hour", "crime_against_category"]


def spatial_summary(incidents: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """The pyramid of a row-level table: one pass over it for level 0, and the
    coarser levels from that."""
    def cell(c: str):
        return F.round(F.bround(c, LOCATION_DECIMALS) * STEPS).cast("bigint")
    rows = incidents.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    base = rows.groupBy(cell("latitude").alias("lat_cell"), cell("longitude").alias("lon_cell"), "date", "hour",
                        "crime_against_category").agg(F.count(F.lit(1)).alias("n"))
    # a count per level and row of level 0: the expansion is by the number of levels, not by incidents
    level = F.explode(F.array(*[F.lit(k) for k in levels])).alias("level")
    raised = base.select(level, "*").select(
        "level", F.expr("shiftright(lat_cell, level)").alias("lat_cell"), F.expr("shiftright(lon_cell, level)").alias("lon_cell"),
        "date", "hour", "crime_against_category", "n")
    return raised.groupBy(*KEYS).agg(F.sum("n").alias("n"))


def write_spatial_summary(incidents: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write (or add a batch to) a pyramid, partitioned by level and sorted by place and date."""
    (spatial_summary(incidents).hint("rebalance", "level").sortWithinPartitions("lat_cell", "lon_cell", "date")
     .write.mode(mode).partitionBy("level").parquet(path))
    return path


def read_spatial_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _matching(pyramid: DataFrame, flt: IncidentFilter, level: int) -> DataFrame:
    if flt.areas or flt.polygon is not None or flt.circle is not None or flt.extra is not None:
        raise ValueError("area, polygon, circle and extra filters need the row-level table")
    dates = IncidentFilter(flt.start, flt.end, flt.end_inclusive, flt.hours, flt.categories, require_coords=False)
    return pyramid.where(F.col("level") == level).where(dates.condition())


def location_frequency(pyramid: DataFrame, flt: IncidentFilter) -> DataFrame:
    """Incidents per 4-decimal location, as ``mapping.location_frequency`` of the rows."""
    cells = _matching(pyramid, flt, 0).groupBy("lat_cell", "lon_cell").agg(F.sum("n").alias("incidents"))
    return cells.select((F.col("lat_cell") / F.lit(float(STEPS))).alias("lat4"),
                        (F.col("lon_cell") / F.lit(float(STEPS))).alias("lon4"), "incidents")


def map_totals(pyramid: DataFrame, flt: IncidentFilter, n: int = MAP_POINTS) -> DataFrame:
    """Matching incidents per category, and of all how many match and how many
    points a map of n shows; from the coarsest level."""
    coarsest = pyramid.agg(F.max("level")).first()[0]
    per_category = _matching(pyramid, flt, coarsest if coarsest is not None else 0).groupBy("crime_against_category").agg(
        F.sum("n").alias("matching"))
    total = per_category.agg(F.sum("matching")).scalar()
    return per_category.select("crime_against_category", "matching", total.alias("matching_total"),
                               F.least(total, F.lit(n).cast("bigint")).alias("shown_total"))


def density(pyramid: DataFrame, flt: IncidentFilter, level: int = 8) -> DataFrame:
    """Incidents per cell of a level, with the cell's corner of least latitude and longitude."""
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    step = float(STEPS) / 2**level
    cells = _matching(pyramid, flt, level).groupBy("lat_cell", "lon_cell").agg(F.sum("n").alias("incidents"))
    return cells.select((F.col("lat_cell") / F.lit(step)).alias("latitude"), (F.col("lon_cell") / F.lit(step)).alias("longitude"),
                        "incidents")
