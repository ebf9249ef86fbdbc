"""Sources and sinks: raw CSV export, gold Parquet table."""

from .gold import gold_table, load_profile, read_gold, schema_report, smoke, stored_rows, write_gold
from .raw import read_raw_csv, write_raw_csv

__all__ = ["gold_table", "load_profile", "read_gold", "schema_report", "smoke", "stored_rows", "write_gold",
           "read_raw_csv", "write_raw_csv"]
