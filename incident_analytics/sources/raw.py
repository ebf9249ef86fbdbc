"""Raw CSV export: read by column name as text (S1), write (tests)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CORRUPT, DATE_PARTS, MISSING_WORDS, RAW_TO_GOLD

# A quote inside a quoted field is doubled; a file whose header differs from
# the others' raises instead of being read by position.
CSV_OPTIONS = {"header": "true", "mode": "PERMISSIVE", "quote": '"', "escape": '"', "enforceSchema": "false",
               "columnNameOfCorruptRecord": CORRUPT}


def raw_schema(columns: list[str]) -> T.StructType:
    """All-text schema of an export with these header names in this order, and
    a column for rows that do not fit it; a missing required name raises."""
    missing = [c for c in RAW_TO_GOLD if c not in columns]
    if "Offense Date" not in columns:
        missing += [c for c in DATE_PARTS if c not in columns]
    if missing:
        raise ValueError(f"the export has no column {', '.join(map(repr, missing))}; its columns are {columns}")
    return T.StructType([T.StructField(c, T.StringType()) for c in [*columns, CORRUPT]])


def header_schema(spark: SparkSession, path: str, multi_line: bool = False) -> T.StructType:
    """``raw_schema`` of the header found at ``path`` (one line is read)."""
    names = (spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
             .csv(path).columns)
    return raw_schema(names)


def named_rows(text: DataFrame) -> DataFrame:
    """Missing-value words → null, ``incident_id`` (when present) → a number."""
    def value(name: str):
        c = F.col(f"`{name}`")
        if name == CORRUPT:
            return c
        c = F.when(~c.isin(*MISSING_WORDS), c)
        return (c.try_cast("bigint") if name == "incident_id" else c).alias(name)
    return text.select(*[value(c) for c in text.columns])


def read_raw_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """S1. Columns by name in whatever order the header has them; no schema
    inference, so a column never changes type between parts of the file. One
    task per file split (not 50,000-row chunks); ``multi_line`` also reads
    quoted line breaks, at the price of one task per file."""
    return named_rows(spark.read.schema(header_schema(spark, path, multi_line)).options(**CSV_OPTIONS)
                      .option("multiLine", multi_line).csv(path))


def write_raw_csv(raw: DataFrame, path: str, files: int | None = None) -> str:
    """Write raw rows as headed CSV files (used to stage test exports)."""
    out = raw.repartition(files) if files else raw
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path
