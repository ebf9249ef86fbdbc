"""Plan inspection for tests: formatted physical plan text and operator names."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def physical_operators(df: DataFrame) -> list[str]:
    """Operator names of the formatted plan's numbered node list."""
    names = re.findall(r"^\(\d+\) ([A-Za-z][A-Za-z ]*?)(?: \[|$)", plan_text(df), flags=re.M)
    return [n.strip() for n in names]
