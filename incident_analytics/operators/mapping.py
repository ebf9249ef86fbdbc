"""Map points and map statistics.

The latest N points: the N-th latest day is found from per-day counts, the
``date >= cutoff`` filter is pushed to the scan, and a ``TakeOrderedAndProject``
takes the top N of the remaining rows (see ``latest``). Everything after the
cut — location frequency, marker scaling — runs on at most N rows, already in
one partition. Frequency is counted on the shown
points only, as the dashboard does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import unknown_if_null
from .filters import IncidentFilter
from .latest import Cutoff, cutoff_day, prune_to_latest, tie_order

MAP_POINTS = 5000
LOCATION_DECIMALS = 4
# Marker size range and the size used when all counts are equal.
SIZE_MIN, SIZE_SPAN, SIZE_FLAT = 5.0, 20.0, 8.0


def _latest(rows: DataFrame, n: int, cutoff: Cutoff | None = None) -> DataFrame:
    rows = prune_to_latest(rows, n, F.col("date"), "date", cutoff)
    return rows.orderBy(F.col("date").desc_nulls_last(), *tie_order(rows)).limit(n)


def latest_points(df: DataFrame, flt: IncidentFilter, n: int = MAP_POINTS) -> DataFrame:
    return _latest(flt.apply(df), n)


def map_points(df: DataFrame, flt: IncidentFilter, n: int = MAP_POINTS) -> DataFrame:
    """Shown points with co-location frequency and marker size."""
    shown = latest_points(df, flt, n)
    lat4 = F.bround("latitude", LOCATION_DECIMALS)
    lon4 = F.bround("longitude", LOCATION_DECIMALS)
    with_freq = shown.withColumn("location_freq", F.count(F.lit(1)).over(Window.partitionBy(lat4, lon4)))
    # ≤ n rows in one partition after the global limit: a whole-set window is cheap here
    everything = Window.partitionBy()
    scaled = (with_freq
              .withColumn("_min", F.min("location_freq").over(everything))
              .withColumn("_max", F.max("location_freq").over(everything)))
    f, lo, hi = F.col("location_freq"), F.col("_min"), F.col("_max")
    size = F.when(hi > lo, F.lit(SIZE_MIN) + (f - lo) / (hi - lo) * F.lit(SIZE_SPAN)).otherwise(F.lit(SIZE_FLAT))
    return scaled.select(
        *(["incident_id"] if "incident_id" in df.columns else []), "date", "crime_against_category",
        unknown_if_null(F.col("offense_sub_category")).alias("hover_text"),
        "latitude", "longitude", "location_freq", size.alias("marker_size"),
    )


def location_frequency(df: DataFrame, flt: IncidentFilter) -> DataFrame:
    """Incidents per 4-decimal location over all matching rows (not only the
    shown ones), with numeric keys; a plain partial aggregate."""
    rows = flt.apply(df)
    return (rows.groupBy(F.bround("latitude", LOCATION_DECIMALS).alias("lat4"),
                         F.bround("longitude", LOCATION_DECIMALS).alias("lon4"))
            .agg(F.count(F.lit(1)).alias("incidents")))


def map_stats(df: DataFrame, flt: IncidentFilter, n: int = MAP_POINTS) -> DataFrame:
    """Per category: points shown; plus shown total and matching total (the
    count before the cut). The total comes from the same per-day counts that
    fix the cutoff, so the filtered rows are aggregated once. When nothing
    matches there is one row, of no category, with zero totals."""
    rows = flt.apply(df)
    cutoff = cutoff_day(rows, n, F.col("date"))
    matching = cutoff.total
    if not matching:
        return df.sparkSession.createDataFrame(
            [(None, 0, 0, 0)], "crime_against_category STRING, points LONG, shown_total LONG, matching_total LONG")
    shown = _latest(rows, n, cutoff)
    per_cat = shown.groupBy("crime_against_category").agg(F.count(F.lit(1)).alias("points"))
    return per_cat.select(
        "crime_against_category", "points",
        F.lit(min(matching, n)).cast("bigint").alias("shown_total"),
        F.lit(matching).cast("bigint").alias("matching_total"),
    )
