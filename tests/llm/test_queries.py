"""The registered queries: every one is there, and those with SQL equal it on the small tables."""

from __future__ import annotations

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from incident_analytics.llm import registry
from test_oracle import _rows


def test_every_operator_is_registered():
    names = entry.queries()
    numbers = sorted(int(m[1]) for m in (re.match(r"op(\d+)_", n) for n in names) if m)
    assert numbers == list(range(1, 14)) and "pipeline" in names
    assert set(registry.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t)}.parquet')")
    df = entry.queries()[name](spark, SF_SMALL)
    cur = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(columns, cur.fetchall())


def test_suffix_dedup_query(spark):
    from .test_suffix_dedup import brute
    df = entry.queries()["op12_suffix_dedup"](spark, SF_SMALL)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert df.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"),
                         ("kept_sha256", "string")]
    assert sorted((tuple(r) for r in df.collect()), key=str) == [r[:5] for r in brute(docs, 200)]
