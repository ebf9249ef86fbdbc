"""Area trends: top or bottom N areas by count or mean hazard, as a series.

Plan (one scan of the base table):

1. filter (date range, coordinates, before the first of the ``as_of`` month);
2. pre-aggregate to one row per (day, area): ``n`` and, for the hazard metric,
   one per (day, area, bin) with the exact hazard sum in units of the bin
   (``functions.numeric``; nulls and NaN as 0). Map-side partial aggregation
   means a hot area or day costs one row per task, not a third of the table in
   one task. Units are integers, so the mean does not depend on how rows were
   split into partitions (a floating sum does, in its last bits), and a score
   of any size has one: infinite scores give an infinite mean, both infinities
   NaN, which ranks above every number. Count trends never read the scores;
3. that small result (days × areas rows, whatever the row count) is
   checkpointed to the shared folder, so the span, the ranking and the
   series all read it instead of re-scanning the base table (with
   ``materialize=False`` Spark reuses the exchange for ranking and series,
   but computes the span from a second, column-pruned scan; that is the
   default for a summary input, which is cheap to re-read);
4. the span (max − min day) is a scalar subquery and picks month / week /
   day buckets; the chosen N areas are a ≤N-row broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import DateLike, granularity, period_start, to_date_value
from ..plans import materialize as _materialize
from .filters import IncidentFilter
from .summary import counted, hazard_sums, is_summary

METRICS = ("count", "hazard")
ORDERS = ("top", "bottom")


def daily_area_totals(df: DataFrame, start: DateLike = None, end: DateLike = None,
                      as_of: DateLike = None, hazard: bool = True) -> DataFrame:
    """(date, area, h_bin, n, h), without hazard (date, area, n), for rows in
    range and before the ``as_of`` month; ``df`` is the row-level table or the
    daily summary."""
    as_of_d = to_date_value(as_of)
    cutoff = F.trunc(F.lit(as_of_d) if as_of_d else F.current_date(), "month")
    rows = IncidentFilter(start=start, end=end).apply(counted(df)).where(F.col("date") < cutoff)
    if not hazard:
        return rows.groupBy("date", "area").agg(F.sum("n").alias("n"))
    return rows.groupBy("date", "area", "h_bin").agg(F.sum("n").alias("n"), F.sum("h").alias("h"))


def _totals(rows: DataFrame, metric: str, value: str, *keys: str) -> DataFrame:
    """(keys, value): count of rows or mean hazard per key."""
    if metric == "hazard":
        return hazard_sums(rows, *keys).select(
            *keys, F.try_divide("h", F.col("n").cast("double")).alias(value))
    return rows.groupBy(*keys).agg(F.sum("n").cast("double").alias(value))


def area_trends(df: DataFrame, start: DateLike = None, end: DateLike = None,
                metric: str = "count", order: str = "top", n: int = 10,
                as_of: DateLike = None, materialize: bool | None = None,
                include_empty: bool = False) -> DataFrame:
    """Series (period, area, value, granularity) for the top/bottom ``n`` areas.

    Ranking: count of rows, or mean hazard with nulls as 0. Ties break by
    area name; the bottom list is the tail of the descending list.

    ``include_empty`` also ranks areas present in the date range but with no
    rows before the ``as_of`` month (the dashboard's categorical areas): count
    0, or an unknown mean that sorts below every known one. They add no series
    rows.
    """
    if metric not in METRICS or order not in ORDERS:
        raise ValueError(f"metric must be one of {METRICS}, order one of {ORDERS}")
    daily = daily_area_totals(df, start, end, as_of, hazard=metric == "hazard")
    if materialize is None:  # re-reading a summary is already cheap
        materialize = not is_summary(df)
    if materialize:
        daily = _materialize(daily)
    span = daily.agg(F.datediff(F.max("date"), F.min("date"))).scalar()

    ranking = _totals(daily.where(F.col("area").isNotNull()), metric, "metric", "area")
    if include_empty:
        seen = (IncidentFilter(start=start, end=end).apply(df)
                .where(F.col("area").isNotNull()).select("area").distinct())
        ranking = seen.join(ranking, "area", "left")
        if metric == "count":
            ranking = ranking.fillna(0.0, ["metric"])
    if order == "top":
        chosen = ranking.orderBy(F.col("metric").desc_nulls_last(), F.col("area").asc())
    else:
        chosen = ranking.orderBy(F.col("metric").asc_nulls_first(), F.col("area").desc())
    chosen = chosen.limit(n).select("area")

    # Inner join with the ≤ n distinct chosen areas. Not a semi join: without
    # materialising, Catalyst would push that below the aggregate and the
    # pre-aggregate would be computed twice instead of reused.
    series = _totals(daily.join(F.broadcast(chosen), "area", "inner")
                     .withColumn("period", period_start(F.col("date"), span)), metric, "value", "period", "area")
    return series.select("period", "area", "value", granularity(span).alias("granularity")).orderBy("period", "area")
