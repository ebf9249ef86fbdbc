"""Streaming ingest: restart with the same checkpoint picks up only new files."""

from __future__ import annotations

from pyspark.sql import functions as F

from conftest import SF_SMALL
from incident_analytics import fixtures, sources, streaming
from incident_analytics.operators import clean
from incident_analytics.session import scratch_path


def test_restart_appends_only_new_files(spark):
    raw = fixtures.raw_incidents(spark, SF_SMALL)
    first, second = raw.where(F.col("incident_id") % 2 == 0), raw.where(F.col("incident_id") % 2 == 1)
    landing = scratch_path(spark, "s-landing")
    gold = scratch_path(spark, "s-gold")
    ckpt = scratch_path(spark, "s-ckpt")

    sources.write_raw_csv(first, landing, files=3)
    streaming.start_ingest(spark, landing, gold, ckpt, files_per_batch=1).awaitTermination()
    after_first = sources.read_gold(spark, gold)
    assert after_first.count() == clean.clean(first).count()

    # a second export lands next to the first; the restarted stream takes only it
    second.repartition(2).write.mode("append").option("header", True).csv(landing)
    streaming.start_ingest(spark, landing, gold, ckpt, files_per_batch=1).awaitTermination()
    out = sources.read_gold(spark, gold)
    want = clean.clean(raw)
    assert out.count() == want.count()
    assert out.select("incident_id").distinct().count() == out.count()
    assert out.exceptAll(want.select(*out.columns)).count() == 0


def test_stream_keeps_summary_current(spark):
    from incident_analytics.operators import kpi, summary, trends
    raw = fixtures.raw_incidents(spark, SF_SMALL)
    first, second = raw.where(F.col("incident_id") % 3 != 0), raw.where(F.col("incident_id") % 3 == 0)
    landing, gold = scratch_path(spark, "s2-landing"), scratch_path(spark, "s2-gold")
    ckpt = scratch_path(spark, "s2-ckpt")
    sources.write_raw_csv(first, landing, files=2)
    streaming.start_ingest(spark, landing, gold, ckpt, files_per_batch=1, summary=True).awaitTermination()
    second.coalesce(1).write.mode("append").option("header", True).csv(landing)
    streaming.start_ingest(spark, landing, gold, ckpt, files_per_batch=1, summary=True).awaitTermination()
    want = clean.clean(raw)
    got = sources.read_gold(spark, gold)
    assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).count() == 0
    s = summary.read_summary(spark, gold)
    assert sorted(map(tuple, kpi.kpis(s).collect())) == sorted(map(tuple, kpi.kpis(want).collect()))
    a = trends.area_trends(s, as_of="2024-06-01").collect()
    b = trends.area_trends(want, as_of="2024-06-01").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
