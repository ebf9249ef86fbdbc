"""Batches of a table: nothing of a load that dies is seen, and running it again gives the table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from incident_analytics import fixtures, loader, sources
from incident_analytics.operators import clean, kpi, summary
from incident_analytics.session import scratch_path
from incident_analytics.sources import batches


@pytest.fixture(scope="module")
def exports(spark):
    raw = fixtures.raw_incidents(spark, SF_SMALL)
    parts = [raw.where(F.pmod("incident_id", F.lit(3)) == k) for k in range(3)]
    return [sources.write_raw_csv(p, scratch_path(spark, "b-raw")) for p in parts], [clean.clean(p) for p in parts]


def same(a, b):
    return a.select(*b.columns).exceptAll(b).count() == 0 and a.count() == b.count()


class Killed(Exception):
    pass


@pytest.mark.parametrize("where", ["write_summary", "publish"])
def test_killed_load_runs_again(spark, exports, monkeypatch, where):
    (first, second, _), (a, b, _) = exports
    gold = scratch_path(spark, "b-gold")
    loader.load_export(spark, first, gold, summary=True)

    def die(*args, **kw):
        raise Killed
    with monkeypatch.context() as m:
        m.setattr(loader if where == "write_summary" else batches, where, die)
        with pytest.raises(Killed):
            loader.load_export(spark, second, gold, mode="append")
    # the rows are written but not seen, and neither is a summary of them
    assert same(sources.gold_table(spark, gold), a)
    assert kpi.kpis(summary.read_summary(spark, gold)).collect() == kpi.kpis(a).collect()
    for _ in range(2):
        loader.load_export(spark, second, gold, mode="append")
        both = a.unionByName(b)
        assert same(sources.gold_table(spark, gold), both)
        assert kpi.kpis(summary.read_summary(spark, gold)).collect() == kpi.kpis(both).collect()
    assert len(batches.live(spark, gold)) == 2


def test_replace_compact_and_remove(spark, exports):
    paths, (a, b, c) = exports
    gold = scratch_path(spark, "b-gold")
    loader.load_export(spark, paths[0], gold)
    loader.load_export(spark, paths[0], gold)                 # the same export replaces itself
    assert same(sources.gold_table(spark, gold), a)
    for path in paths[1:]:
        loader.load_export(spark, path, gold, mode="append", summary=path is paths[2])
    whole = a.unionByName(b).unionByName(c)
    assert kpi.kpis(summary.read_summary(spark, gold)).collect() == kpi.kpis(whole).collect()
    loader.compact(spark, gold, layout="curve")
    assert same(sources.gold_table(spark, gold), whole) and len(batches.live(spark, gold)) == 1
    assert kpi.kpis(summary.read_summary(spark, gold)).collect() == kpi.kpis(whole).collect()
    assert len(batches.remove_unlisted(spark, gold)) >= 4 and batches.remove_unlisted(spark, gold) == []
    assert same(sources.gold_table(spark, gold), whole)
    loader.load_export(spark, paths[1], gold)
    assert same(sources.gold_table(spark, gold), b)


def test_two_writers_both_count(spark, exports, monkeypatch):
    """A writer that finds its version taken adds its batch to the newer list."""
    gold = scratch_path(spark, "b-gold")
    assert batches.publish(spark, gold, "batch=a")
    read, done = batches._read, []

    def slow(*args):
        listed = read(*args)
        if not done:
            done.append(1)
            assert batches.publish(spark, gold, "batch=b")
        return listed
    monkeypatch.setattr(batches, "_read", slow)
    assert batches.publish(spark, gold, "batch=c")
    assert batches.live(spark, gold) == ["batch=a", "batch=b", "batch=c"]
    assert not batches.publish(spark, gold, "batch=b")


def test_empty_batch(spark, exports):
    (first, *_), (a, *_) = exports
    gold = scratch_path(spark, "b-gold")
    assert loader.add_batch(a.where("false"), gold, "none", summary=True)
    assert sources.read_gold(spark, gold).count() == 0 and kpi.profile(summary.read_summary(spark, gold)).first()["records"] == 0
    loader.load_export(spark, first, gold, mode="append")
    assert same(sources.gold_table(spark, gold), a)


def test_mode_is_checked(spark, exports):
    with pytest.raises(ValueError, match="mode"):
        loader.load_export(spark, exports[0][0], scratch_path(spark, "b-gold"), mode="replace")


def row_groups_met(path, box):
    """(row groups whose minima and maxima meet the box of latitudes and longitudes, all row groups)."""
    import glob

    import pyarrow.parquet as pq
    met = total = 0
    for file in glob.glob(f"{path.removeprefix('file:')}/year=2023/*.parquet"):
        meta = pq.read_metadata(file)
        at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            stats = [meta.row_group(g).column(at[c]).statistics for c in ("latitude", "longitude")]
            total += 1
            met += all(s.min <= hi and s.max >= lo for s, (lo, hi) in zip(stats, box, strict=True))
    return met, total


def test_map_filters_skip_row_groups(spark):
    """A multi-file year along the curve: a circle and a polygon meet under a fifth of its row groups."""
    rows = spark.range(300_000).select(
        F.col("id").alias("incident_id"), F.date_add(F.lit("2023-01-01").cast("date"), (F.rand(1) * 365).cast("int")).alias("date"),
        (F.rand(2) * 24).cast("int").alias("hour"), (F.lit(47.5) + F.rand(3) * 0.23).alias("latitude"),
        (F.lit(-122.43) + F.rand(4) * 0.2).alias("longitude"), F.lit("X").alias("area"))
    boxes = {"circle": ((47.599, 47.6135), (-122.343, -122.321)), "polygon": ((47.52, 47.56), (-122.40, -122.36))}
    met = {}
    for layout in ("days", "curve"):
        path = scratch_path(spark, f"b-{layout}")
        sources.write_gold(rows, path, layout=layout, partitions=64)
        for name, box in boxes.items():
            found, total = row_groups_met(path, box)
            met[layout, name] = found / total
            assert total >= 50
    assert met["curve", "circle"] < 0.2 and met["curve", "polygon"] < 0.2
    assert met["days", "circle"] == 1.0


def test_curve_layout_keeps_rows_and_odd_places(spark, make_incidents):
    import datetime as dt
    rows = make_incidents([{"incident_id": i, "latitude": x, "longitude": y, "date": d, "hour": h}
                           for i, (x, y, d, h) in enumerate(
                               [(None, None, None, None), (89.0, 179.0, dt.date(2023, 12, 31), 23), (-89.0, -179.0, dt.date(2024, 12, 31), 0),
                                (47.6, -122.3, dt.date(2023, 1, 1), 5), (float("nan"), float("inf"), None, 99)])])
    path = scratch_path(spark, "b-curve")
    sources.write_gold(rows, path, layout="curve")
    assert spark.read.parquet(path).count() == 5
