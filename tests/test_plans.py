"""Plan checks: pushdown reaches the scan, no Python in the hot path, top-k
plans as TakeOrderedAndProject, spatial joins are equi-joins (no cartesian)."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from incident_analytics import IncidentFilter, fixtures, loader, sources
from incident_analytics.operators import details, kpi, mapping
from incident_analytics.plans import physical_operators, plan_text
from incident_analytics.session import scratch_path

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas")
CROSS_NODES = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.fixture(scope="module")
def gold_path(spark):
    csv_path = sources.write_raw_csv(fixtures.raw_incidents(spark, SF_SMALL), scratch_path(spark, "p-raw"))
    path = scratch_path(spark, "p-gold")
    loader.load_export(spark, csv_path, path)
    return path


def _pushed(plan: str) -> set[str]:
    line = [ln for ln in plan.splitlines() if ln.startswith("PushedFilters")][0]
    return {f.strip() for f in line.split("[", 1)[1].rstrip("]").replace("), ", ")|").split("|")}


def test_date_filter_reaches_parquet(spark, gold_path):
    df = sources.read_gold(spark, gold_path)
    plan = plan_text(kpi.kpis(df, "2023-01-01", "2023-06-30"))
    assert {"IsNotNull(latitude)", "IsNotNull(longitude)", "GreaterThanOrEqual(date,2023-01-01)",
            "LessThanOrEqual(date,2023-06-30)"} <= _pushed(plan)
    assert "PartitionFilters: [isnotnull(year" not in plan  # no year bounds asked for here


def test_year_bounds_prune_partitions(spark, gold_path):
    plan = plan_text(sources.read_gold(spark, gold_path, "2023-01-01", "2023-06-30"))
    assert "PartitionFilters: [isnotnull(year" in plan and ">= 2023" in plan


def test_projection_is_pruned(spark, gold_path):
    plan = plan_text(kpi.kpis(spark.read.parquet(gold_path), "2023-01-01", "2023-06-30"))
    schema = [ln for ln in plan.splitlines() if ln.startswith("ReadSchema")][0]
    assert "hazardness" not in schema and "location" not in schema


def test_circle_box_is_pushed(spark, gold_path):
    df = spark.read.parquet(gold_path)
    plan = plan_text(IncidentFilter(circle=entry.Circle(47.6, -122.3, 805)).apply(df))
    assert "GreaterThanOrEqual(latitude," in plan and "LessThanOrEqual(longitude," in plan


def test_topk_plans(spark, gold_path):
    df = spark.read.parquet(gold_path)
    assert "TakeOrderedAndProject" in physical_operators(details.incident_details(df, IncidentFilter()))
    assert "TakeOrderedAndProject" in physical_operators(mapping.latest_points(df, IncidentFilter()))


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - {
    "ingest_roundtrip", "ingest_stream", "ingest_profile", "schema_report"}))
def test_no_python_or_cross_join(spark, name):
    plan = plan_text(entry.queries()[name](spark, SF_SMALL))
    for node in PYTHON_NODES + CROSS_NODES:
        assert node not in plan, f"{name}: {node}"


def test_filter_prunes_year_partitions(spark, gold_path):
    df = spark.read.parquet(gold_path)
    plan = plan_text(IncidentFilter("2023-02-01", "2023-03-01").apply(df))
    assert "PartitionFilters: [isnotnull(year" in plan and "(year#" in plan and ">= 2023" in plan
