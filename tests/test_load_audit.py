"""A load's audit: the counts and rejected rows of the one scan that loads."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from incident_analytics import fixtures, loader, sources
from incident_analytics.operators import clean
from incident_analytics.sources import batches


@pytest.fixture(scope="module")
def exports(spark, tmp_path_factory):
    """Two halves of the raw export, the second without the shooting type."""
    raw = fixtures.raw_incidents(spark, SF_SMALL)
    half = F.pmod("incident_id", F.lit(2)) == 0
    return [sources.write_raw_csv(raw.where(half), str(tmp_path_factory.mktemp("csv") / "a"), files=3),
            sources.write_raw_csv(raw.where(~half).drop("Shooting Type Group"), str(tmp_path_factory.mktemp("csv") / "b"), files=2)]


@pytest.fixture
def gold(tmp_path):
    return str(tmp_path / f"gold-{uuid.uuid4().hex[:8]}")


def counts(df):
    return {r["rule"]: r["rows"] for r in df.collect()}


def rows(df):
    return sorted(map(str, df.collect()))


def test_audit_and_rows_equal_the_plain_load(spark, exports, gold, tmp_path):
    raw = sources.read_raw_csv(spark, exports[0])
    table = loader.load_export(spark, exports[0], gold, summary=True, audit=True)
    assert rows(table) == rows(loader.load_export(spark, exports[0], str(tmp_path / "plain")))
    assert counts(loader.read_audit(spark, gold)) == counts(clean.clean_audit(raw))
    rejects = loader.read_rejects(spark, gold)
    got = counts(loader.read_audit(spark, gold))
    assert rejects.count() == got["rows_in"] - got["rows_out"] > 0
    by_rule = {r["rule"]: r["n"] for r in rejects.select(F.explode("failed").alias("rule")).groupBy("rule").agg(F.count("*").alias("n")).collect()}
    assert by_rule == {k: v for k, v in got.items() if re.match("c[3-8]_", k) and v}
    # the raw rows as read, before placeholders go
    texts = {str(r["incident_id"]): r.asDict() | {"incident_id": str(r["incident_id"])} for r in raw.collect()}
    assert all(r["raw"] == texts[r["raw"]["incident_id"]] for r in rejects.collect())
    assert any(r["raw"]["Latitude"] == "abc" for r in rejects.collect())


def test_the_export_is_read_once(spark, exports, gold, monkeypatch):
    """The clean rows come from what was written aside, so no later step reads the CSV."""
    seen = []
    monkeypatch.setattr(loader, "write_gold", lambda df, path, **kw: seen.append(df.inputFiles()) or sources.write_gold(df, path, **kw))
    loader.load_export(spark, exports[0], gold, audit=True)
    assert seen and seen[0] and all("_rejects" in f and f.endswith(".parquet") for f in seen[0])


def test_append_replay_and_replace(spark, exports, gold):
    loader.load_export(spark, exports[0], gold, audit=True)
    for _ in range(2):  # the second changes nothing
        loader.load_export(spark, exports[1], gold, mode="append", audit=True)
    first, second = (counts(clean.clean_audit(sources.read_raw_csv(spark, e))) for e in exports)
    assert counts(loader.read_audit(spark, gold)) == {k: first[k] + second[k] for k in first}
    rejects = loader.read_rejects(spark, gold)
    assert rejects.count() == sum(c["rows_in"] - c["rows_out"] for c in (first, second))
    assert rejects.where("raw['incident_id'] % 2 = 1 AND map_contains_key(raw, 'Shooting Type Group')").count() == 0
    loader.load_export(spark, exports[1], gold, audit=True)  # replaces both
    assert counts(loader.read_audit(spark, gold)) == second
    assert batches.remove_unlisted(spark, gold)
    assert counts(loader.read_audit(spark, gold)) == second


def test_killed_load_leaves_no_audit(spark, exports, gold, monkeypatch):
    loader.load_export(spark, exports[0], gold, audit=True)
    before = counts(loader.read_audit(spark, gold))
    with monkeypatch.context() as m:
        m.setattr(loader, "add_batch", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            loader.load_export(spark, exports[1], gold, mode="append", audit=True)
    assert counts(loader.read_audit(spark, gold)) == before
    loader.load_export(spark, exports[1], gold, mode="append", audit=True)
    assert counts(loader.read_audit(spark, gold))["rows_in"] > before["rows_in"]


def test_without_audit_and_without_rows(spark, exports, gold, tmp_path):
    loader.load_export(spark, exports[0], gold)
    assert counts(loader.read_audit(spark, gold)) == {}
    assert loader.read_rejects(spark, gold).count() == 0
    empty = sources.write_raw_csv(fixtures.raw_incidents(spark, SF_SMALL).where("1 = 0"), str(tmp_path / "empty"), files=1)
    other = str(tmp_path / "gold-empty")
    assert loader.load_export(spark, empty, other, audit=True).count() == 0
    assert set(counts(loader.read_audit(spark, other)).values()) == {0}
    assert loader.read_rejects(spark, other).count() == 0
