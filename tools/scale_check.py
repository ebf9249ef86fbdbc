"""Production-path timing: headline operators over a written gold table.

The registered queries rebuild the fixture join each time; a deployment
loads once and queries the year-partitioned gold table. This tool writes the
sf fixture repeated ``--copies`` times with shifted ids (optionally shifted
years, so partitions multiply) to the shared folder, then times each
operator over ``read_gold`` and prints one JSON line with the timings.

Usage: python tools/scale_check.py [--sf-dir DIR] [--copies K] [--spread-years]
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

import query_params as P  # noqa: E402
from incident_analytics import Circle, IncidentFilter, fixtures, sources  # noqa: E402
from incident_analytics.operators import breakdown, details, kpi, mapping, summary, trends  # noqa: E402
from incident_analytics.session import build_session, scratch_path  # noqa: E402


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.1")
    ap.add_argument("--copies", type=int, default=6)
    ap.add_argument("--spread-years", action="store_true",
                    help="copy k is moved back 2·k years (more partitions, same density)")
    ap.add_argument("--cpus", type=int, default=8)
    args = ap.parse_args()

    real_stdout, sys.stdout = sys.stdout, sys.stderr
    spark = build_session(f"local[{args.cpus}]", shuffle_partitions=max(8, args.cpus))
    base = fixtures.incidents(spark, args.sf_dir)
    span = base.agg(F.max("incident_id")).first()[0] + 1
    # each row repeated with a copy number (a generator, no join)
    wide = base.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(args.copies - 1).cast("long"))))
    shifted = wide.withColumn("incident_id", F.col("incident_id") + F.col("copy") * F.lit(span))
    if args.spread_years:
        years = -2 * F.col("copy").cast("int")
        new_date = F.add_months(F.col("date"), years * 12)
        shifted = (shifted.withColumn("date", new_date)
                   .withColumn("datetime", F.concat(F.col("date").cast("string"), F.lit(" "), F.col("time"))))
    gold = shifted.drop("copy")

    path = scratch_path(spark, "scale-gold")
    t0 = time.perf_counter()
    sources.write_gold(gold, path)
    ingest_s = time.perf_counter() - t0
    rows = spark.read.parquet(path).count()

    summary_path = scratch_path(spark, "scale-summary")
    t0 = time.perf_counter()
    summary.write_summary(spark.read.parquet(path), summary_path)
    summary_s = time.perf_counter() - t0
    summ = summary.read_summary(spark, summary_path)
    summary_rows = summ.count()

    df = sources.read_gold(spark, path)
    flt = IncidentFilter(*P.FULL_RANGE, hours=P.DAY_HOURS, categories=P.ALL_CATEGORIES,
                         circle=Circle(*P.CENTER, P.RADIUS_WIDE_M))
    jobs = {
        "kpis": lambda: kpi.kpis(df, *P.KPI_RANGE),
        "profile": lambda: kpi.profile(df),
        "trend_count_top": lambda: trends.area_trends(df, *P.FULL_RANGE, as_of=P.AS_OF_AFTER),
        "trend_hazard_bottom": lambda: trends.area_trends(df, *P.FULL_RANGE, metric="hazard",
                                                          order="bottom", as_of=P.AS_OF_AFTER),
        "category_breakdown": lambda: breakdown.category_breakdown(df, *P.KPI_RANGE),
        "subcategory_drilldown": lambda: breakdown.subcategory_breakdown(df, "PERSON", *P.KPI_RANGE),
        "incident_details": lambda: details.incident_details(df, flt),
        "map_points": lambda: mapping.map_points(df, IncidentFilter(categories=P.ALL_CATEGORIES)),
        "map_stats": lambda: mapping.map_stats(df, IncidentFilter(categories=P.ALL_CATEGORIES)),
        "polygon_filter": lambda: IncidentFilter(*P.FULL_RANGE, polygon=P.POLYGON_U).apply(df)
        .agg(F.count(F.lit(1)).alias("n")),
    }
    for name in ["kpis", "profile", "trend_count_top", "trend_hazard_bottom", "category_breakdown",
                 "subcategory_drilldown"]:
        jobs[f"{name}_from_summary"] = {
            "kpis": lambda: kpi.kpis(summ, *P.KPI_RANGE),
            "profile": lambda: kpi.profile(summ),
            "trend_count_top": lambda: trends.area_trends(summ, *P.FULL_RANGE, as_of=P.AS_OF_AFTER),
            "trend_hazard_bottom": lambda: trends.area_trends(summ, *P.FULL_RANGE, metric="hazard",
                                                              order="bottom", as_of=P.AS_OF_AFTER),
            "category_breakdown": lambda: breakdown.category_breakdown(summ, *P.KPI_RANGE),
            "subcategory_drilldown": lambda: breakdown.subcategory_breakdown(summ, "PERSON", *P.KPI_RANGE),
        }[name]
    for fn in jobs.values():  # warm-up
        fn().toArrow()
    timings = {}
    for name, fn in jobs.items():
        t = time.perf_counter()
        fn().toArrow()
        timings[name] = round(time.perf_counter() - t, 3)
    total_files = len(spark.read.parquet(path).inputFiles())
    spark.stop()
    sys.stdout = real_stdout
    print(json.dumps({"rows": rows, "copies": args.copies, "spread_years": args.spread_years,
                      "ingest_sec": round(ingest_s, 3), "summary_sec": round(summary_s, 3),
                      "summary_rows": summary_rows, "queries": timings,
                      "total_sec": round(sum(timings.values()), 3), "gold_files": total_files}))


if __name__ == "__main__":
    main()
