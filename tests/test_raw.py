"""The CSV source reads by name: column order, date layouts, quoting, missing words, unreadable rows; one writer a folder."""

from __future__ import annotations

import datetime as dt
import os

import pytest

from incident_analytics import loader, sources, streaming
from incident_analytics.operators import clean, details, mapping
from incident_analytics.operators.filters import IncidentFilter
from incident_analytics.session import scratch_path
from test_clean import GOOD

PARTS = {"Offense Year": "2023", "Offense Month": "3", "Offense Day": "5", "Offense Time": "09:15:00"}


def quoted(value) -> str:
    return "" if value is None else '"' + str(value).replace('"', '""') + '"'


@pytest.fixture(scope="module")
def export(spark):
    def make(rows: list[dict], extra_lines: list[str] = ()) -> str:
        path = scratch_path(spark, "raw-csv").removeprefix("file://").removeprefix("file:")
        os.makedirs(path)
        names = list(rows[0])
        lines = [",".join(names)] + [",".join(quoted(r[c]) for c in names) for r in rows] + list(extra_lines)
        with open(f"{path}/part.csv", "w") as f:
            f.write("\n".join(lines) + "\n")
        return path
    return make


def load(spark, path):
    return clean.clean(sources.read_raw_csv(spark, path))


def test_columns_in_any_order_without_an_id(spark, export):
    out = load(spark, export([dict(reversed(GOOD.items()))])).first()
    assert (out["date"], out["hour"], out["area"], out["latitude"]) == (dt.date(2023, 3, 5), 9, "DOWNTOWN", 47.61)


def test_date_in_parts_and_no_unused_columns(spark, export):
    unused = ("Offense Date", "Beat", "Reporting Area", "Shooting Type Group")
    row = {**PARTS, **{k: v for k, v in GOOD.items() if k not in unused}}
    raw = sources.read_raw_csv(spark, export([row, {**row, "Offense Month": "2", "Offense Day": "30"}]))
    got = sorted(((r["date"], r["time"], r["hour"]) for r in clean.clean(raw).collect()), key=str)
    assert got == sorted([(dt.date(2023, 3, 5), "09:15:00", 9), (None, "09:15:00", 9)], key=str)
    assert {r["rule"]: r["rows"] for r in clean.clean_audit(raw).collect()}["rows_out"] == 2


def test_quotes_and_commas(spark, export):
    out = load(spark, export([{**GOOD, "Block Address": 'PINE "OLD" ST, 2ND'}])).first()
    assert out["location"] == 'PINE "OLD" ST, 2ND'


@pytest.mark.parametrize("word", ["NA", "nan", "N/A", "null", "NaN"])
def test_missing_words(spark, export, word):
    out = load(spark, export([{**GOOD, "Precinct": word, "Hazardness": word}, {**GOOD, "Neighborhood": word}])).collect()
    assert [(r["precinct"], r["hazardness"], r["area"]) for r in out] == [(None, None, "DOWNTOWN")]


def test_missing_column_and_other_header_raise(spark, export):
    with pytest.raises(ValueError, match="Neighborhood"):
        sources.read_raw_csv(spark, export([{k: v for k, v in GOOD.items() if k != "Neighborhood"}]))
    path = export([GOOD])
    with open(f"{path}/other.csv", "w") as f:
        f.write(",".join(reversed(GOOD)) + "\n" + ",".join(quoted(v) for v in reversed(GOOD.values())) + "\n")
    with pytest.raises(Exception, match="(?i)header"):
        load(spark, path).collect()


def test_unreadable_rows_are_counted(spark, export):
    raw = sources.read_raw_csv(spark, export([GOOD], ["only,three,fields"]))
    audit = {r["rule"]: r["rows"] for r in clean.clean_audit(raw).collect()}
    assert (audit["rows_in"], audit["unreadable_rows"], audit["rows_out"]) == (2, 1, 1)


def test_load_and_stream_fill_one_table(spark, export):
    path, gold, checkpoint = export([GOOD]), scratch_path(spark, "raw-gold"), scratch_path(spark, "raw-ckpt")
    streaming.start_ingest(spark, path, gold, checkpoint).awaitTermination()
    assert sources.read_gold(spark, gold).count() == 1
    loader.load_export(spark, path, gold, mode="append")
    streaming.start_ingest(spark, path, gold, checkpoint).awaitTermination()
    assert sources.read_gold(spark, gold).count() == 2
    plain = scratch_path(spark, "raw-gold")
    sources.write_gold(load(spark, path), plain)
    for add in (lambda: loader.load_export(spark, path, plain, mode="append"),
                lambda: streaming.start_ingest(spark, path, plain, scratch_path(spark, "raw-ckpt"))):
        with pytest.raises(ValueError, match="not written in batches"):
            add()
    with pytest.raises(ValueError, match="holds batches"):
        sources.write_gold(load(spark, path), gold, mode="append")


def test_views_without_an_id(spark, export):
    gold = load(spark, export([GOOD, {**GOOD, "Neighborhood": "BALLARD"}]))
    everything = IncidentFilter("2023-01-01", "2023-12-31")
    table = details.incident_details(gold, everything)
    assert [r["area"] for r in details.details_page(table).collect()] == ["BALLARD", "DOWNTOWN"]
    assert mapping.map_points(gold, everything).count() == 2
    nothing = mapping.map_stats(gold, IncidentFilter("2020-01-01", "2020-12-31")).collect()
    assert [tuple(r) for r in nothing] == [(None, 0, 0, 0)]
