"""Materialise a small intermediate result once.

Used where several branches of one answer read the same aggregate of a large
scan (e.g. the trend span, ranking and series). ``checkpoint()`` writes to the
shared folder named by ``spark.checkpoint.dir``, so the big scan runs once and
a lost executor later does not re-trigger it. Never ``localCheckpoint``: its
blocks live on executors that may disappear.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import shared_dir


def materialize(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
