"""Command line: load an export into the gold table and run the post-load checks.

    python -m incident_analytics load --csv EXPORT_DIR_OR_GLOB --gold GOLD_DIR [--summary]
                                      [--audit] [--append] [--master local[8]]
    python -m incident_analytics check --gold GOLD_DIR

``load`` cleans every row of the CSV export and writes the year-partitioned
gold table (replacing it, or appending with ``--append``), optionally with the
daily summary and the cleaning's audit, then prints the checks. ``check`` prints them for an existing
table: schema conformance (missing / extra / moved columns), one smoke row,
row and coordinate counts, and the date span.
"""

from __future__ import annotations

import argparse
import sys

from . import loader, sources
from .session import build_session


def _checks(spark, gold: str) -> int:
    table = sources.stored_rows(spark, gold).drop("batch")
    report = sources.schema_report(table).orderBy("position").collect()
    missing = [r["column_name"] for r in report if r["status"] == "missing"]
    for r in report:
        print(f"  {r['column_name']:<24} {r['status']:<8} non-null {r['non_null']}")
    smoke = sources.smoke(table).collect()
    prof = sources.load_profile(table).first()
    print(f"smoke row: {'ok' if smoke else 'none'}")
    print(f"rows: {prof['records']:,}  with coordinates: {prof['records_with_coords']:,}  "
          f"dates: {prof['min_date']} .. {prof['max_date']}")
    return 1 if missing else 0


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="python -m incident_analytics")
    sub = ap.add_subparsers(dest="cmd", required=True)
    load = sub.add_parser("load", help="clean a CSV export into the gold table")
    load.add_argument("--csv", required=True)
    load.add_argument("--gold", required=True)
    load.add_argument("--summary", action="store_true", help="keep the daily summary with the table")
    load.add_argument("--audit", action="store_true", help="keep the cleaning's counts and the rejected rows with the table")
    load.add_argument("--append", action="store_true")
    check = sub.add_parser("check", help="post-load checks of a gold table")
    check.add_argument("--gold", required=True)
    for p in (load, check):
        p.add_argument("--master", help="e.g. local[8]; default: from spark-submit")
        p.add_argument("--cluster", action="store_true", help="apply the large-cluster settings")
    args = ap.parse_args(argv)

    spark = build_session(args.master, cluster=args.cluster)
    try:
        if args.cmd == "load":
            loader.load_export(spark, args.csv, args.gold, mode="append" if args.append else "overwrite",
                               summary=args.summary, audit=args.audit)
            print(f"loaded {args.csv} -> {args.gold}" + (" (+ summary)" if args.summary else ""))
        return _checks(spark, args.gold)
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
