"""Table schemas: the gold incident table and the raw CSV-like input."""

from __future__ import annotations

from pyspark.sql import types as T

# Gold table columns in their stored order (the reference's 14), plus our own
# ``incident_id`` used for deterministic tie-breaks.
GOLD_COLUMNS = [
    "date", "time", "hour", "datetime", "offense", "offense_sub_category",
    "crime_against_category", "location", "area", "precinct", "sector",
    "hazardness", "latitude", "longitude",
]

INCIDENTS = T.StructType([
    T.StructField("incident_id", T.LongType()),
    T.StructField("date", T.DateType()),
    T.StructField("time", T.StringType()),
    T.StructField("hour", T.IntegerType()),
    T.StructField("datetime", T.StringType()),
    T.StructField("offense", T.StringType()),
    T.StructField("offense_sub_category", T.StringType()),
    T.StructField("crime_against_category", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("area", T.StringType()),
    T.StructField("precinct", T.StringType()),
    T.StructField("sector", T.StringType()),
    T.StructField("hazardness", T.DoubleType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
])

# Raw export columns, all text as they arrive in the CSV.
RAW_COLUMNS = [
    "Offense Date", "Offense Category", "Offense Sub Category",
    "NIBRS Crime Against Category", "Block Address", "Neighborhood", "Precinct",
    "Sector", "Beat", "Reporting Area", "Shooting Type Group", "Hazardness",
    "Latitude", "Longitude",
]

RAW_INCIDENTS = T.StructType(
    [T.StructField("incident_id", T.LongType())]
    + [T.StructField(name, T.StringType()) for name in RAW_COLUMNS]
)

# The other date layout of an export: parts in columns of their own.
DATE_PARTS = ("Offense Year", "Offense Month", "Offense Day", "Offense Time")

# Text of a row that does not fit the header (filled by the CSV reader).
CORRUPT = "_corrupt_record"

# Words that a CSV field may hold for a missing value.
MISSING_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
                 "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# Raw → gold names (fixed values of the source export).
RAW_TO_GOLD = {
    "Offense Category": "offense",
    "Offense Sub Category": "offense_sub_category",
    "NIBRS Crime Against Category": "crime_against_category",
    "Block Address": "location",
    "Neighborhood": "area",
    "Precinct": "precinct",
    "Sector": "sector",
    "Hazardness": "hazardness",
    "Latitude": "latitude",
    "Longitude": "longitude",
}

CATEGORIES = ("PERSON", "PROPERTY", "SOCIETY")
