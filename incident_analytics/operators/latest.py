"""Latest-N selection that stays cheap on a very large table.

A plain ``orderBy(...).limit(n)`` (``TakeOrderedAndProject``) makes every
input partition send its own top n rows to the driver: at a hundred thousand
partitions and n = 5,000 that is hundreds of millions of rows. Instead:

1. count matching rows per day (a partial aggregate; one row per day);
2. walk the days from the latest back to find the day by which n rows are
   reached — a window over at most one row per calendar day — and fetch that
   one date;
3. filter ``day >= cutoff`` with a literal, which reaches the Parquet scan
   (year partitions and date-sorted row groups are skipped);
4. if more than SLACK * n rows are left (one day may hold a third of a table),
   look closer in the same way, into what ties at the cut only: counts per
   range of the cutoff day's time, each pass a ``RANGES``-th of the one before,
   until a range of at most n rows (or one instant) holds the cut; then, among
   rows of one instant, counts per range of ids. Rows without a day are cut by id alone. Then take the
   ordered top n of what is left, at most SLACK * n rows of all partitions
   together (and those of one id at the cut).

The answer is identical to the plain top-n: whatever a step drops sorts behind
at least n rows that stay. A table without ids ties on all columns; there the
last step is left out.
"""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tie_order(rows: DataFrame) -> list[Column]:
    """Order among equal sort keys: the id, or every column when there is none."""
    return [F.col(f"`{c}`").asc() for c in (["incident_id"] if "incident_id" in rows.columns else rows.columns)]


SLACK = 2
RANGES = 1024


class Cutoff(NamedTuple):
    """The latest day with at least n rows on or after it (None if fewer than n
    rows have a day), the number of rows after that day, on or after it (without
    a cutoff: of all rows with a day), and of all rows."""

    day: dt.date | None
    after: int
    kept: int
    total: int


def cutoff_day(rows: DataFrame, n: int, day: Column) -> Cutoff:
    """From one aggregate: per-day counts, null day included."""
    per_day = rows.groupBy(day.alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per calendar day (plus one for no day): a whole-set window is small and bounded
    running = (Window.orderBy(F.col("_day").desc_nulls_last())
               .rowsBetween(Window.unboundedPreceding, 0))
    dated = F.when(F.col("_day").isNotNull(), F.col("_n"))
    cum = per_day.withColumn("_cum", F.sum(dated).over(running))
    # the first day that reaches n has the least running count of those that do
    reached = F.when((F.col("_cum") >= n) & F.col("_day").isNotNull(), F.struct("_cum", "_day", "_n"))
    row = cum.agg(F.min(reached).alias("cut"), F.sum(dated).alias("dated"), F.sum("_n").alias("total")).first()
    total = int(row["total"] or 0)
    if row["cut"] is None:
        return Cutoff(None, int(row["dated"] or 0), int(row["dated"] or 0), total)
    return Cutoff(row["cut"]["_day"], row["cut"]["_cum"] - row["cut"]["_n"], row["cut"]["_cum"], total)


def _narrow(tied: DataFrame, key: Column, need: int, most: int, latest: bool) -> tuple[int, int, int, int]:
    """The range (low, high) of a whole-number key in which the ``need``-th row by
    key lies, how many of its rows are needed, and its rows: at most ``most``, or
    those of one key. Each pass counts RANGES parts of the range before."""
    ends = tied.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(key).alias("n")).first()
    lo, hi, own = ends["lo"], ends["hi"], ends["n"]
    while own > most and lo < hi:
        width = -(-(hi - lo + 1) // RANGES)
        # keys can be further apart than a long is large
        at = F.floor((key.cast("decimal(20,0)") - F.lit(lo)) / F.lit(width).cast("decimal(20,0)")).cast("int")
        counts = tied.where(key.between(lo, hi)).groupBy(at.alias("k")).agg(F.count(F.lit(1)).alias("n"))
        for r in counts.orderBy(F.col("k").desc() if latest else F.col("k").asc()).collect():
            if r["n"] >= need:
                break
            need -= r["n"]
        own, lo, hi = r["n"], lo + r["k"] * width, min(hi, lo + (r["k"] + 1) * width - 1)
    return lo, hi, need, own


def _least_ids(tied: DataFrame, need: int, most: int) -> Column:
    """Condition for the first ``need`` rows of tied by id, null ids first, and at most ``most`` more."""
    key = F.col("incident_id")
    none = tied.where(key.isNull()).count()
    if need <= none:
        return key.isNull()
    return key.isNull() | (key <= F.lit(_narrow(tied, key, need - none, most, latest=False)[1]))


def prune_to_latest(rows: DataFrame, n: int, day: Column, pushable_day: str | None = "date",
                    cutoff: Cutoff | None = None, instant: Column | None = None) -> DataFrame:
    """Drop rows that are surely behind the latest n.

    ``day`` is the day of the sort key; ``pushable_day`` names a stored date
    column that equals it wherever the sort key is not null (adds a literal
    filter the scan can use, plus a ``year`` bound when the table has one);
    ``instant`` is the sort key itself where it is finer than the day. Ties go
    by ``incident_id``. ``cutoff`` may be passed when already known.
    """
    cutoff = cutoff or cutoff_day(rows, n, day)
    ids = "incident_id" in rows.columns
    if cutoff.day is None:
        if cutoff.total <= SLACK * n or not ids:
            return rows
        return rows.where(day.isNotNull() | _least_ids(rows.where(day.isNull()), n - cutoff.kept, n))

    def since(df: DataFrame) -> DataFrame:
        out = df.where(day >= F.lit(cutoff.day))
        if pushable_day:
            out = out.where(F.col(pushable_day) >= F.lit(cutoff.day))
            if "year" in df.columns:
                out = out.where(F.col("year") >= cutoff.day.year)
        return out

    out, need, own = since(rows), n - cutoff.after, cutoff.kept - cutoff.after
    later, tied = day > F.lit(cutoff.day), day == F.lit(cutoff.day)
    if cutoff.kept <= SLACK * n:
        return out
    if instant is not None:
        part = F.extract(F.lit("SECOND"), instant)
        micros = (F.hour(instant) * 3600 + F.minute(instant) * 60).cast("long") * 1_000_000 + (part * 1_000_000).cast("long")
        lo, hi, need, own = _narrow(out.where(tied), micros, need, n, latest=True)
        later, tied = later | (tied & (micros > hi)), tied & micros.between(lo, hi)
    if own > n and ids:  # all of one day, or of one instant
        tied = tied & _least_ids(out.where(tied), need, n)
    return out.where(later | tied)
