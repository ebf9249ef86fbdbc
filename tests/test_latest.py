"""The two-phase latest-N equals the plain ordered top-N, and its cutoff is pushed."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from incident_analytics import IncidentFilter, fixtures
from incident_analytics.operators import details, mapping
from incident_analytics.operators.latest import SLACK, cutoff_day, prune_to_latest
from incident_analytics.plans import plan_text
from incident_analytics.session import scratch_path


@pytest.fixture(scope="module")
def incidents(spark):
    return fixtures.incidents(spark, SF_MID)


@pytest.mark.parametrize("n", [1, 13, 14, 500, 9803, 20000])
def test_latest_points_equal_plain_topn(incidents, n):
    flt = IncidentFilter(hours=(6, 22))
    got = [r["incident_id"] for r in mapping.latest_points(incidents, flt, n).collect()]
    plain = (flt.apply(incidents).orderBy(F.col("date").desc_nulls_last(), F.col("incident_id"))
             .limit(n).collect())
    assert got == [r["incident_id"] for r in plain]


@pytest.mark.parametrize("n", [7, 500])
def test_details_equal_plain_topn(incidents, n):
    flt = IncidentFilter(categories=["PERSON"])
    got = [r["incident_id"] for r in details.incident_details(incidents, flt, n).collect()]
    exact = [r["incident_id"] for r in details.incident_details(incidents, flt, n, trust_date=False).collect()]
    ts = F.col("datetime").try_cast("timestamp_ntz")
    plain = (flt.apply(incidents).orderBy(ts.desc_nulls_last(), F.col("incident_id")).limit(n).collect())
    assert got == exact == [r["incident_id"] for r in plain]


def test_cutoff_is_pushed(spark, incidents):
    path = scratch_path(spark, "latest-gold")
    incidents.withColumn("year", F.year("date")).write.partitionBy("year").parquet(path)
    df = spark.read.parquet(path)
    cutoff = cutoff_day(df, 50, F.col("date")).day
    plan = plan_text(mapping.latest_points(df, IncidentFilter(), 50))
    assert f"GreaterThanOrEqual(date,{cutoff})" in plan
    assert f"(year#" in plan and f">= {cutoff.year})" in plan


def one_day(incidents, clock):
    """Four fifths of the rows on one day, at the clock times given."""
    day = F.lit("2023-06-01").cast("date")
    time = F.expr(clock)
    return (incidents.withColumn("date", F.when(F.col("incident_id") % 5 == 0, F.date_sub(day, 9)).otherwise(day))
            .withColumn("datetime", F.concat(F.col("date").cast("string"), F.lit(" "), time)))


CLOCKS = {"spread": "time", "one": "'12:00:00'", "two": "if(incident_id % 4 = 0, '23:59:59', '00:00:00')",
          "micros": "concat('08:00:00.', lpad(string(incident_id % 1000), 6, '0'))", "none": "'no time'"}


@pytest.mark.parametrize("clock", sorted(CLOCKS))
def test_hot_day_equals_plain_topn(incidents, clock):
    df = one_day(incidents, CLOCKS[clock])
    ts = F.col("datetime").try_cast("timestamp_ntz")
    for n in (3, 200):
        got = [r["incident_id"] for r in details.incident_details(df, IncidentFilter(), n).collect()]
        plain = IncidentFilter().apply(df).orderBy(ts.desc_nulls_last(), F.col("incident_id")).limit(n).collect()
        assert got == [r["incident_id"] for r in plain]


@pytest.mark.parametrize("clock", ["spread", "one", "micros", "none"])
def test_no_partition_keeps_more_than_its_share(incidents, clock):
    """With four fifths of all rows on one day, the rows left for the top n are at most SLACK times n in all."""
    df = one_day(incidents, CLOCKS[clock]).withColumn("_ts", F.col("datetime").try_cast("timestamp_ntz")).repartition(20)
    n = 150
    left = prune_to_latest(df, n, F.to_date("_ts"), None, instant=F.col("_ts"))
    by_partition = [r["count"] for r in left.groupBy(F.spark_partition_id()).count().collect()]
    assert n <= sum(by_partition) <= SLACK * n and max(by_partition) < n
    assert prune_to_latest(df, n, F.col("date"), "date").count() <= SLACK * n


def test_ids_far_apart_null_and_equal(spark, make_incidents):
    import datetime as dt
    ids = [None, None, -2**63, 2**63 - 1, 0, 1, 2, *[7] * 30, *range(100, 160)]
    df = make_incidents([{"incident_id": i, "date": dt.date(2023, 1, 1), "latitude": 47.6, "longitude": -122.3} for i in ids])
    for n in (1, 2, 3, 5, 9, 40, 90):
        got = [r["incident_id"] for r in mapping.latest_points(df, IncidentFilter(), n).collect()]
        assert got == sorted(ids, key=lambda i: (i is not None, i or 0))[:n]
    undated = df.withColumn("date", F.lit(None).cast("date")).unionByName(df.limit(3))
    for n in (2, 9, 40):
        plain = undated.orderBy(F.col("date").desc_nulls_last(), "incident_id").limit(n)
        assert ([r["incident_id"] for r in mapping.latest_points(undated, IncidentFilter(), n).collect()]
                == [r["incident_id"] for r in plain.collect()])
