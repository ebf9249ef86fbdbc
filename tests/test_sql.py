"""SQL functions agree with their Column twins; SQL over the registered views."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import query_params as P
from conftest import SF_SMALL
from incident_analytics import Circle, IncidentFilter, fixtures, sources, sql
from incident_analytics.functions import dates, geo, text
from incident_analytics.operators import kpi, summary
from incident_analytics.session import scratch_path


@pytest.fixture(scope="module")
def registered(spark):
    inc = fixtures.incidents(spark, SF_SMALL)
    gold = scratch_path(spark, "sql-gold")
    sources.write_gold(inc, gold)
    summ = summary.write_summary(inc, scratch_path(spark, "sql-summary"))
    sql.register(spark, gold_path=gold, summary_path=summ)
    return spark.read.parquet(gold), spark.read.parquet(summ)


def test_geo_functions_match_columns(spark, registered):
    rnd = random.Random(5)
    rows = [(rnd.uniform(47.4, 47.8), rnd.uniform(-122.5, -122.1)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "latitude DOUBLE, longitude DOUBLE").withColumn("gj", F.lit(P.POLYGON_U))
    ring = geo.ring_from_geojson(P.POLYGON_U)
    got = df.select(
        F.expr("haversine_m(47.6062D, -122.3321D, latitude, longitude)").alias("h_sql"),
        geo.haversine_m(47.6062, -122.3321, "latitude", "longitude").alias("h_col"),
        F.expr("point_in_ring(latitude, longitude, ring_from_geojson(gj))").alias("p_sql"),
        geo.point_in_ring("latitude", "longitude", ring).alias("p_col"),
    ).collect()
    assert all(r["h_sql"] == r["h_col"] for r in got)
    assert all(r["p_sql"] == r["p_col"] for r in got) and any(r["p_sql"] for r in got)


def test_text_and_date_functions_match_columns(spark, registered):
    df = spark.createDataFrame([("9:05:00", "X" * 45, "1st  Ave", 200), ("25:00:00", "short", "Pike, Seattle", 90),
                                (None, None, None, 10)], "t STRING, s STRING, a STRING, span INT")
    df = df.withColumn("d", F.lit("2023-05-17").cast("date"))
    got = df.select(
        F.expr("hour_of(t)").alias("a1"), dates.hour_of(F.col("t")).alias("b1"),
        F.expr("truncate_label(s)").alias("a2"), text.truncate_label(F.col("s")).alias("b2"),
        F.expr("address_key(a)").alias("a3"), text.address_key(F.col("a")).alias("b3"),
        F.expr("period_start(d, span)").alias("a4"), dates.period_start(F.col("d"), F.col("span")).alias("b4"),
        F.expr("granularity(span)").alias("a5"), dates.granularity(F.col("span")).alias("b5"),
    ).collect()
    for r in got:
        for i in range(1, 6):
            assert r[f"a{i}"] == r[f"b{i}"]


def test_sql_over_views(spark, registered):
    gold, summ = registered
    n = spark.sql("""SELECT count(*) AS n FROM incidents
        WHERE date BETWEEN DATE'2022-01-01' AND DATE'2023-12-31'
          AND haversine_m(47.6062D, -122.3321D, latitude, longitude) <= 3219""").first()["n"]
    want = IncidentFilter(*P.FULL_RANGE, circle=Circle(47.6062, -122.3321, 3219)).apply(gold).count()
    assert n == want > 0
    total = spark.sql("SELECT sum(n) AS n FROM incident_daily WHERE has_coords").first()["n"]
    assert total == kpi.kpis(summ).first()["total"]
