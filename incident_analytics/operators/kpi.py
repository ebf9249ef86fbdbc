"""Headline numbers: dataset profile, selection summary, KPIs, category counts.

Each answer is one aggregate pass with conditional sums, so the table is read
once and only one row (or one row per category) leaves the executors. Every
function takes the row-level table or the daily summary (``summary``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import DateLike, to_date_value
from ..functions.numeric import percent
from ..schema import CATEGORIES
from .filters import IncidentFilter
from .summary import counted, has_coords, is_summary, total


def profile(df: DataFrame) -> DataFrame:
    """Rows, rows with coordinates, first and last date (dates ignore nulls).
    ``df``: the row-level table or the daily summary."""
    rows = counted(df)
    return rows.agg(
        total().alias("records"),
        total(where=has_coords(df)).alias("records_with_coords"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
    )


def selection_summary(df: DataFrame, start: DateLike, end: DateLike) -> DataFrame:
    """Rows in the date range (with coordinates) against all rows, and the
    number of days between the bounds (end − start, not inclusive)."""
    in_range = IncidentFilter(start=start, end=end).condition(summary=is_summary(df))
    s, e = to_date_value(start), to_date_value(end)
    out = counted(df).agg(
        total(where=in_range).alias("selected"),
        total().alias("total"),
    )
    return out.select(
        "selected", "total",
        percent(F.col("selected"), F.col("total")).alias("selected_pct"),
        F.datediff(F.lit(e), F.lit(s)).alias("days"),
    )


def kpis(df: DataFrame, start: DateLike = None, end: DateLike = None,
         categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """Total incidents and one count and share per category, date filter only."""
    rows = IncidentFilter(start=start, end=end).apply(counted(df))
    cat = F.col("crime_against_category")
    counts = rows.agg(
        total().alias("total"),
        *[total(where=cat == F.lit(c)).alias(c.lower()) for c in categories],
    )
    return counts.select(
        "total",
        *[F.col(c.lower()) for c in categories],
        *[percent(F.col(c.lower()), F.col("total")).alias(f"{c.lower()}_pct") for c in categories],
    )


def category_counts(df: DataFrame, start: DateLike = None, end: DateLike = None) -> DataFrame:
    """Rows per category in the date range (null categories dropped)."""
    rows = IncidentFilter(start=start, end=end).apply(counted(df))
    return (rows.where(F.col("crime_against_category").isNotNull())
            .groupBy("crime_against_category")
            .agg(F.sum("n").alias("incidents")))
