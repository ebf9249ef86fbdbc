from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from incident_analytics.schema import INCIDENTS  # noqa: E402
from incident_analytics.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", app_name="incident-analytics-tests", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make_incidents(spark):
    """Build a small incidents frame from dicts; missing columns are null."""
    names = [f.name for f in INCIDENTS.fields]

    def make(rows: list[dict]):
        data = [tuple(r.get(n) for n in names) for r in rows]
        return spark.createDataFrame(data, INCIDENTS)

    return make
