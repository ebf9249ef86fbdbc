"""Daily summary table: the date-only views answered without the raw rows.

Profile, selection summary, KPIs, category counts, options, trends,
breakdown and drill-down only group by date, area, category and
sub-category, so all of them can be answered from one row per
(date, area, category, sub-category, has-coordinates, hazard bin) holding a
row count ``n`` and an exact hazard sum ``h`` in units of the bin. Its size is
bounded by days × areas × categories × the few bins that scores fall in, not by
the number of incidents, so at 100 TB these views read megabytes instead of the
table. Every view function accepts either table: ``counted`` gives raw rows
``n = 1``, and the views sum ``n`` and, for the hazard metric, ``h`` by bin, so
both inputs give identical answers.

Row-level filters (hour, polygon, circle) and row-level views (detail
table, map) need the raw rows; ``IncidentFilter`` refuses them on a summary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import from_units, unit_bin, units
from ..sources import batches

_STORED = ("date DATE, area STRING, crime_against_category STRING, offense_sub_category STRING, has_coords BOOLEAN, "
           "h_bin INT, n LONG, h DECIMAL(38,0), year INT, batch STRING")
SUMMARY_KEYS = ["date", "area", "crime_against_category", "offense_sub_category", "has_coords"]


def is_summary(df: DataFrame) -> bool:
    return "n" in df.columns and "has_coords" in df.columns


def has_coords(df: DataFrame) -> Column:
    if is_summary(df):
        return F.col("has_coords")
    return F.col("latitude").isNotNull() & F.col("longitude").isNotNull()


def counted(df: DataFrame) -> DataFrame:
    """Rows with a count ``n``, hazard bin ``h_bin`` and hazard units ``h``
    (raw rows: 1 and the hazard, null and NaN as 0)."""
    if is_summary(df):
        return df
    hazard = F.coalesce(F.nanvl("hazardness", F.lit(0.0)), F.lit(0.0))
    return (df.withColumn("n", F.lit(1).cast("bigint"))
              .withColumn("h_bin", unit_bin(hazard)).withColumn("h", units(hazard, F.col("h_bin"))))


def hazard_sums(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, h): per key the count and, exact up to one rounding a bin, the
    sum of hazards, from counted rows or sums of them."""
    binned = rows.groupBy(*keys, "h_bin").agg(F.sum("n").alias("n"), F.sum("h").alias("h"))
    entry = F.struct(F.col("h_bin").alias("bin"), F.col("h").alias("units"))
    return binned.groupBy(*keys).agg(F.sum("n").alias("n"), from_units(F.collect_list(entry)).alias("h"))


def total(col: str = "n", where: Column | None = None) -> Column:
    """Sum of counts (optionally of rows matching ``where``); 0 when none."""
    c = F.col(col) if where is None else F.when(where, F.col(col))
    return F.coalesce(F.sum(c), F.lit(0).cast("bigint"))


def daily_summary(gold: DataFrame) -> DataFrame:
    """One row per (date, area, category, sub-category, has_coords, h_bin).
    A partial aggregate: a hot key costs one row per task before the shuffle."""
    rows = counted(gold).withColumn("has_coords", has_coords(gold))
    return rows.groupBy(*SUMMARY_KEYS, "h_bin").agg(F.sum("n").alias("n"), F.sum("h").alias("h"))


def write_summary(gold: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write the summary partitioned by year; the rebalance splits a large year
    into several tasks and merges small ones."""
    (daily_summary(gold).withColumn("year", F.year("date"))
        .hint("rebalance", "year").sortWithinPartitions("date", "area")
        .write.mode(mode).partitionBy("year").parquet(path))
    return path


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """The summary at ``path``: one that ``write_summary`` wrote there, or that of
    the loaded table at ``path`` (of the batches its readers see)."""
    if batches.live(spark, path) is not None:
        return batches.read_batches(spark, path, _STORED, batches.SUMMARY)
    return spark.read.parquet(path)
