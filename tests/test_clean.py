"""Cleaning rules (C1–C14, P1–P4) on hand-made raw rows, and the load path."""

from __future__ import annotations

import datetime as dt

import pytest

from incident_analytics import loader, sources
from incident_analytics.operators import clean
from incident_analytics.schema import RAW_COLUMNS, RAW_INCIDENTS
from incident_analytics.session import scratch_path

GOOD = {
    "Offense Date": "2023-03-05 09:15:00", "Offense Category": "THEFT",
    "Offense Sub Category": "LARCENY", "NIBRS Crime Against Category": "PROPERTY",
    "Block Address": "1XX BLOCK OF PINE ST", "Neighborhood": "DOWNTOWN", "Precinct": "WEST",
    "Sector": "K", "Beat": "K1", "Reporting Area": "101", "Shooting Type Group": None,
    "Hazardness": "3.5", "Latitude": "47.61", "Longitude": "-122.33",
}


@pytest.fixture(scope="module")
def raw_of(spark):
    def make(variants: list[dict]):
        rows = []
        for i, v in enumerate(variants):
            r = dict(GOOD)
            r.update(v)
            rows.append(tuple([i] + [r[c] for c in RAW_COLUMNS]))
        return spark.createDataFrame(rows, RAW_INCIDENTS)
    return make


def kept(df):
    return sorted(r["incident_id"] for r in clean.clean(df).collect())


def test_good_row_and_derived_columns(raw_of):
    out = clean.clean(raw_of([{}])).first()
    assert out["date"] == dt.date(2023, 3, 5) and out["time"] == "09:15:00" and out["hour"] == 9
    assert out["datetime"] == "2023-03-05 09:15:00"
    assert (out["offense"], out["area"], out["hazardness"], out["latitude"]) == ("THEFT", "DOWNTOWN", 3.5, 47.61)


@pytest.mark.parametrize("bad", [
    {"Latitude": "abc"}, {"Latitude": "0.0"}, {"Longitude": "-120.0"}, {"Latitude": None},
    {"Latitude": "-"}, {"Neighborhood": "UNKNOWN"}, {"Neighborhood": "FK ERROR"},
    {"Neighborhood": "OOJ"}, {"Neighborhood": None}, {"NIBRS Crime Against Category": "ANY"},
    {"NIBRS Crime Against Category": "NOT_A_CRIME"}, {"Offense Sub Category": "999"},
    {"Offense Sub Category": ""}, {"Offense Sub Category": "UNKNOWN"},
    {"Block Address": None}, {"Reporting Area": "REDACTED"}, {"Beat": None},
    {"Sector": "None"}, {"Sector": "99"}, {"Sector": None},
])
def test_rejecting_rules(raw_of, bad):
    assert kept(raw_of([{}, bad])) == [0]


def test_placeholders_become_null_but_row_stays(raw_of):
    out = clean.clean(raw_of([{"Precinct": "-", "Hazardness": "-1.0", "Offense Category": "REDACTED"}])).first()
    assert out["precinct"] is None and out["hazardness"] is None and out["offense"] is None


@pytest.mark.parametrize("od,date,hour,time", [
    ("2023-02-30 10:00:00", None, 10, "10:00:00"),     # impossible date → null
    (None, None, 0, None),                             # missing → null date, hour 0
    ("2023-03-05 25:00:00", dt.date(2023, 3, 5), 0, "25:00:00"),
    ("2023-03-05 9:05:00", dt.date(2023, 3, 5), 9, "9:05:00"),
    ("2023-03-05 09:5:1", dt.date(2023, 3, 5), 9, "09:5:1"),
    ("2023-03-05", dt.date(2023, 3, 5), 0, None),
])
def test_date_parts(raw_of, od, date, hour, time):
    out = clean.clean(raw_of([{"Offense Date": od}])).first()
    assert (out["date"], out["hour"], out["time"]) == (date, hour, time)


def test_audit_counts(raw_of):
    df = raw_of([{}, {"Latitude": "abc"}, {"Sector": "99"}, {"Precinct": "-"}])
    audit = {r["rule"]: r["rows"] for r in clean.clean_audit(df).collect()}
    assert audit["rows_in"] == 4 and audit["rows_out"] == 2
    assert audit["c2_unparseable_coordinates"] == 1 and audit["c8_sector"] == 1
    assert audit["c1_placeholder_rows"] == 1 and audit["c9_shooting_filled"] == 4


def test_load_export_round_trip(spark, raw_of):
    df = raw_of([{}, {"Offense Date": "2022-12-31 23:00:00"}, {"Latitude": "abc"}])
    csv_path = sources.write_raw_csv(df, scratch_path(spark, "t-raw"))
    gold_path = scratch_path(spark, "t-gold")
    out = loader.load_export(spark, csv_path, gold_path)
    assert sorted(r["incident_id"] for r in out.collect()) == [0, 1]
    on_disk = sources.stored_rows(spark, gold_path)
    assert sorted(r["year"] for r in on_disk.select("year").distinct().collect()) == [2022, 2023]
    # year bounds prune partitions: only 2023 files are read
    assert [r["incident_id"] for r in sources.read_gold(spark, gold_path, start="2023-01-01").collect()] == [0]
    # S3: datetime bounds are accepted; T8: plain limit
    bounded = sources.read_gold(spark, gold_path, start=dt.datetime(2023, 1, 1, 15, 30), end=dt.date(2023, 12, 31))
    assert [r["incident_id"] for r in bounded.collect()] == [0]
    assert sources.read_gold(spark, gold_path, limit=1).count() == 1
    assert sources.read_gold(spark, gold_path, limit=0).count() == 2
    from incident_analytics.operators import kpi, summary
    loader.load_export(spark, csv_path, gold_path, mode="append", batch_id="again", summary=True)
    assert sources.gold_table(spark, gold_path).count() == 4
    assert kpi.profile(summary.read_summary(spark, gold_path)).first()["records"] == 4  # the first summary covers the table
    loader.load_export(spark, csv_path, gold_path, mode="append", batch_id="third")     # later batches bring theirs
    assert sources.gold_table(spark, gold_path).count() == 6
    assert kpi.profile(summary.read_summary(spark, gold_path)).first()["records"] == 6
    report = {r["column_name"]: r["status"] for r in sources.schema_report(on_disk).collect()}
    assert report["year"] == "extra" and report["incident_id"] == "ok"
    assert sources.smoke(on_disk).count() == 1


def test_command_line_load_and_check(spark, raw_of, capsys):
    from incident_analytics.__main__ import _checks
    df = raw_of([{}, {"Offense Date": "2022-12-31 23:00:00"}, {"Sector": "99"}])
    csv_path = sources.write_raw_csv(df, scratch_path(spark, "t-cli-raw"))
    gold_path = scratch_path(spark, "t-cli-gold")
    loader.load_export(spark, csv_path, gold_path)
    assert _checks(spark, gold_path) == 0
    out = capsys.readouterr().out
    assert "rows: 2  with coordinates: 2" in out and "year                     extra" in out
