"""Gold incident table on Parquet: write (S4, S5), scan (S2, S3), checks.

Layout (S5, in place of the B-tree indexes of a row store): Hive partitions by
``year``; rows are spread with a ``REBALANCE`` on ``year`` — one shuffle, no
sampling pass over the input, and AQE splits an oversized year (say a third
of all rows) into advisory-size tasks and merges small ones, so files come
out near one size — then sorted by (date, area) inside each file, so Parquet
row-group statistics prune date and area predicates. Or, with ``layout="curve"``,
dealt and sorted by year and a space-filling curve over place, date and hour, so
the statistics prune map filters too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import DateLike, to_date_value
from ..schema import GOLD_COLUMNS, INCIDENTS
from . import batches
from .layout import curve_key

MAX_RECORDS_PER_FILE = 5_000_000
# Columns of many values that are asked for by equality. Few-valued ones (area,
# category) are dictionary pages, which the scan tests the same way.
BLOOM_COLUMNS = ("location", "incident_id")
_STORED = T.StructType([*INCIDENTS.fields, T.StructField("year", T.IntegerType()), T.StructField("batch", T.StringType())])


def write_gold(gold: DataFrame, path: str, mode: str = "overwrite",
               partitions: int | None = None, layout: str = "days") -> str:
    """S4 + S5: rows as a plain table. ``mode`` is ``overwrite`` (replace) or
    ``append``; an append is not safe to retry, ``loader.add_batch`` is. A folder
    that holds batches is not appended to.

    ``layout``: ``days`` sorts files by (date, area); ``curve`` deals rows by year
    and space-filling curve (``layout.curve_key``; one sampling pass over the
    input more), for tables that are mostly read by place. ``partitions`` asks for
    an exact count of range partitions."""
    spark = gold.sparkSession
    if mode == "append" and batches.live(spark, path) is not None:
        raise ValueError(f"{path} holds batches; rows appended to it would be hidden")
    out = gold.withColumn("year", F.year("date"))
    if layout == "curve":
        out = out.withColumn("_curve", curve_key())
        spread = (out.repartitionByRange(partitions, "year", "_curve") if partitions
                  else out.repartitionByRange("year", "_curve"))
        spread = spread.sortWithinPartitions("year", "_curve").drop("_curve")
    else:
        spread = (out.repartitionByRange(partitions, "date", "incident_id") if partitions
                  else out.hint("rebalance", "year")).sortWithinPartitions("date", "area")
    writer = spread.write.mode(mode).option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
    for name in BLOOM_COLUMNS:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    writer.partitionBy("year").parquet(path)
    return path


def gold_table(spark: SparkSession, path: str, folders: list[str] | None = None) -> DataFrame:
    """All columns of the table at ``path``, of its listed batches or of the folders named."""
    if folders:
        return spark.read.schema(_STORED).option("basePath", path).parquet(*[f"{path}/{f}" for f in folders])
    return batches.read_batches(spark, path, _STORED)


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    """The table's files with the columns and types they really have (the
    conformance check's input; ``gold_table`` reads them as the fixed schema)."""
    listed = batches.live(spark, path)
    folders = [f"{path}/{name}" for name in listed] if listed else [path]
    return spark.read.option("basePath", path).option("mergeSchema", True).parquet(*folders)


def read_gold(spark: SparkSession, path: str, start: DateLike = None, end: DateLike = None,
              limit: int | None = None) -> DataFrame:
    """The gold columns, coordinates required, optional date bounds
    (also turned into ``year`` bounds for partition pruning) and row limit
    (``0``/``None`` = no limit). Bounds may be text, dates or datetimes."""
    df = gold_table(spark, path)
    cond = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    s, e = to_date_value(start), to_date_value(end)
    if s is not None:
        cond = cond & (F.col("date") >= F.lit(s))
        if "year" in df.columns:
            cond = cond & (F.col("year") >= s.year)
    if e is not None:
        cond = cond & (F.col("date") <= F.lit(e))
        if "year" in df.columns:
            cond = cond & (F.col("year") <= e.year)
    cols = (["incident_id"] if "incident_id" in df.columns else []) + GOLD_COLUMNS
    out = df.where(cond).select(*cols)
    return out.limit(limit) if limit else out


def smoke(df: DataFrame) -> DataFrame:
    """One row with coordinates (a post-load smoke check)."""
    return df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).limit(1)


def load_profile(df: DataFrame) -> DataFrame:
    """Rows and rows with coordinates in one pass, plus the date span
    (the same answer as the dataset profile, A1/A2)."""
    from ..operators.kpi import profile
    return profile(df)


def schema_report(df: DataFrame, expected=INCIDENTS) -> DataFrame:
    """S6 (+U2): each expected column as ``ok``, ``moved`` (present, other
    position) or ``missing``; each unexpected column as ``extra``; with the
    non-null count of every present column from one aggregate pass."""
    spark = df.sparkSession
    want = [f.name for f in expected.fields]
    have = df.columns
    rows = []  # built from the schema (metadata), not from data
    for i, name in enumerate(want):
        if name not in have:
            rows.append((name, "missing", i))
        else:
            rows.append((name, "ok" if i < len(have) and have[i] == name else "moved", i))
    for j, name in enumerate(have):
        if name not in want:
            rows.append((name, "extra", len(want) + j))
    status = spark.createDataFrame(rows, "column_name STRING, status STRING, position INT")
    present = [c for c in have]
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in present])
    long_counts = counts.unpivot([], present, "column_name", "non_null")
    return (status.join(long_counts, "column_name", "left")
            .select("column_name", "status", "position", "non_null"))
