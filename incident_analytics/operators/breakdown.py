"""Category overview (top sub-categories per category) and drill-down.

Both aggregate first; the per-category top-k is a ``row_number`` window on
the aggregated (category, sub-category) counts, which Spark plans with a
``WindowGroupLimit`` so only k rows per category survive the sort. Every
function takes the row-level table or the daily summary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import DateLike
from ..functions.text import truncate_label
from .filters import IncidentFilter
from .summary import counted

CAT, SUB = "crime_against_category", "offense_sub_category"
# Bar opacity by rank, 0.9 − 0.05·(rank − 1), at least 0.4.
OPACITY_TOP, OPACITY_STEP, OPACITY_MIN = 0.9, 0.05, 0.4


def subcategory_counts(df: DataFrame, start: DateLike = None, end: DateLike = None) -> DataFrame:
    rows = IncidentFilter(start=start, end=end).apply(counted(df))
    return (rows.where(F.col(CAT).isNotNull() & F.col(SUB).isNotNull())
            .groupBy(CAT, SUB).agg(F.sum("n").alias("incidents")))


def category_breakdown(df: DataFrame, start: DateLike = None, end: DateLike = None,
                       top: int = 10) -> DataFrame:
    """Top ``top`` sub-categories in each category with rank, opacity and the
    category total (over all its sub-categories); categories by total."""
    counts = subcategory_counts(df, start, end)
    by_cat = Window.partitionBy(CAT)
    ranked = Window.partitionBy(CAT).orderBy(F.col("incidents").desc(), F.col(SUB).asc())
    out = (counts
           .withColumn("category_total", F.sum("incidents").over(by_cat))
           .withColumn("rank", F.row_number().over(ranked))
           .where(F.col("rank") <= top))
    opacity = F.greatest(F.lit(OPACITY_TOP) - (F.col("rank") - 1) * F.lit(OPACITY_STEP),
                         F.lit(OPACITY_MIN))
    return (out.select(CAT, SUB, "incidents", "category_total", "rank", opacity.alias("opacity"))
            .orderBy(F.col("category_total").desc(), F.col(CAT), F.col("rank")))


def category_rollup(df: DataFrame, start: DateLike = None, end: DateLike = None) -> DataFrame:
    """Two-level totals: (category, sub-category), category, grand total.
    ``level`` is the grouping id: 0 leaf, 1 category, 3 grand total."""
    rows = IncidentFilter(start=start, end=end).apply(counted(df))
    rows = rows.where(F.col(CAT).isNotNull() & F.col(SUB).isNotNull())
    return (rows.rollup(CAT, SUB)
            .agg(F.grouping_id().cast("int").alias("level"), F.sum("n").alias("incidents")))


def subcategory_breakdown(df: DataFrame, category: str | None = None,
                          start: DateLike = None, end: DateLike = None,
                          top: int = 20, include_empty: bool = False) -> DataFrame:
    """Drill-down: the ``top`` sub-categories (of ``category`` if given) with a
    display label cut at 40 characters. Rank 1 is the largest; the chart
    shows them in reverse.

    ``include_empty`` also ranks sub-categories seen anywhere in the date
    range but not in this category, with count 0 (the dashboard's categorical
    columns list them); zeros order by name.
    """
    rows = IncidentFilter(start=start, end=end).apply(counted(df))
    picked = rows.where(F.col(CAT) == F.lit(category)) if category else rows
    counts = (picked.where(F.col(SUB).isNotNull()).groupBy(SUB)
              .agg(F.sum("n").alias("incidents")))
    if include_empty:
        labels = rows.where(F.col(SUB).isNotNull()).select(SUB).distinct()
        counts = (labels.join(counts, SUB, "left")
                  .select(SUB, F.coalesce("incidents", F.lit(0).cast("bigint")).alias("incidents")))
    order = [F.col("incidents").desc(), F.col(SUB).asc()]
    best = counts.orderBy(*order).limit(top)
    # ≤ top rows, already on one partition after the global limit
    return (best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
            .select(SUB, truncate_label(F.col(SUB)).alias("label"), "incidents", "rank"))
