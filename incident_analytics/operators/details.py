"""Detail table: the latest N matching incidents, display columns, paging.

The latest n rows are found in steps (see ``latest``): the day by which n rows
are reached, in a day of many rows the second and the ids, then a pushed-down
``date >= cutoff`` scan and an ordered top n (``TakeOrderedAndProject``) over
the few remaining rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.dates import format_datetime, parse_datetime
from .filters import IncidentFilter
from .latest import prune_to_latest, tie_order

DETAIL_ROWS = 500
PAGE_SIZE = 20
HAZARD_DECIMALS = 1

# Display names of the dashboard table (fixed values), by our column name.
DISPLAY_NAMES = {
    "date_time": "Date & Time",
    "offense_type": "Offense Type",
    "crime_against": "Crime Against",
    "location": "location",
    "area": "area",
    "hazard_score": "Hazard Score",
}


def incident_details(df: DataFrame, flt: IncidentFilter, n: int = DETAIL_ROWS,
                     display_names: bool = False, trust_date: bool = True) -> DataFrame:
    """Latest ``n`` rows by parsed ``datetime`` (unparseable last; ties by id,
    or by every column where the table has no id).

    ``trust_date``: the stored ``date`` equals the day of ``datetime`` wherever
    that parses, as in every table built by ``clean`` (``datetime`` is
    ``date ‖ ' ' ‖ time``); the date cutoff is then pushed to the scan. Pass
    False for tables where the two may disagree.
    """
    rows = flt.apply(df).withColumn("_ts", parse_datetime(F.col("datetime")))
    rows = prune_to_latest(rows, n, F.to_date(F.col("_ts")), "date" if trust_date else None, instant=F.col("_ts"))
    latest = rows.orderBy(F.col("_ts").desc_nulls_last(), *tie_order(rows)).limit(n)
    ids = ["incident_id"] if "incident_id" in df.columns else []
    out = latest.select(
        *ids,
        format_datetime(F.col("_ts")).alias("date_time"),
        F.col("offense_sub_category").alias("offense_type"),
        F.col("crime_against_category").alias("crime_against"),
        "location",
        "area",
        F.bround("hazardness", HAZARD_DECIMALS).alias("hazard_score"),
    )
    if display_names:
        out = out.select(*ids, *[F.col(k).alias(v) for k, v in DISPLAY_NAMES.items()])
    return out


# Column-filter operators of the table (typed conditions).
TABLE_FILTER_OPS = ("=", "!=", "<", "<=", ">", ">=", "contains")


def table_filter(conditions: list[tuple[str, str, object]]) -> Column:
    """AND of per-column conditions ``(column, op, value)`` for ``details_page``;
    ``contains`` is a case-sensitive substring test on text."""
    out = F.lit(True)
    for name, op, value in conditions:
        c = F.col(name)
        if op not in TABLE_FILTER_OPS:
            raise ValueError(f"unknown operator {op!r}; use one of {TABLE_FILTER_OPS}")
        cond = {"=": lambda: c == F.lit(value), "!=": lambda: c != F.lit(value),
                "<": lambda: c < F.lit(value), "<=": lambda: c <= F.lit(value),
                ">": lambda: c > F.lit(value), ">=": lambda: c >= F.lit(value),
                "contains": lambda: c.contains(F.lit(str(value)))}[op]()
        out = out & cond
    return out


def details_page(details: DataFrame, page: int = 0, size: int = PAGE_SIZE,
                 sort_by: str | None = None, ascending: bool = True,
                 where: Column | None = None) -> DataFrame:
    """One page of the detail table, after an optional column filter (typed
    conditions such as ``=``, ``<``, ``>``, ``contains``) and an optional sort.
    The default order is the table's own (latest first, then id)."""
    t = details.where(where) if where is not None else details
    order = [c.asc_nulls_last() if up else c.desc_nulls_last() for c, up in _page_keys(sort_by, ascending)]
    return t.orderBy(*order, *tie_order(t)).offset(page * size).limit(size)


def _page_keys(sort_by: str | None, ascending: bool) -> list[tuple[Column, bool]]:
    keys = [(F.col(f"`{sort_by}`"), ascending)] if sort_by else []
    return [*keys, (F.col("date_time"), False)]


def _behind(column: Column, value, ascending: bool, nulls_last: bool) -> Column:
    """Whether a row's key comes after a value in the order of one column."""
    if value is None:
        return F.lit(False) if nulls_last else column.isNotNull()
    further = (column > F.lit(value)) if ascending else (column < F.lit(value))
    return F.coalesce(further, F.lit(nulls_last))


def page_after(details: DataFrame, last: Row | dict | None, size: int = PAGE_SIZE, sort_by: str | None = None,
               ascending: bool = True, where: Column | None = None) -> DataFrame:
    """The page behind row ``last`` of the page before (None: the first page), in
    the order of ``details_page``.

    What precedes the page is filtered out by the sort key, not sorted and
    skipped, so any page costs one scan and a top ``size``. Ties go by
    ``incident_id``, or by every column where there is none; rows equal in all of
    them are one place in the order and only shown on the page they first reach.
    """
    t = details.where(where) if where is not None else details
    if last is not None:
        last = last.asDict() if isinstance(last, Row) else last
        ties = ["incident_id"] if "incident_id" in t.columns else t.columns
        names = ([sort_by] if sort_by else []) + ["date_time"]
        keys = [(name, up, True) for name, (_, up) in zip(names, _page_keys(sort_by, ascending), strict=True)]
        keys += [(name, True, False) for name in ties]
        behind, equal = F.lit(False), F.lit(True)
        for name, up, nulls_last in keys:
            column, value = F.col(f"`{name}`"), last[name]
            behind = behind | (equal & _behind(column, value, up, nulls_last))
            equal = equal & column.eqNullSafe(F.lit(value))
        t = t.where(behind)
    order = [c.asc_nulls_last() if up else c.desc_nulls_last() for c, up in _page_keys(sort_by, ascending)]
    return t.orderBy(*order, *tie_order(t)).limit(size)
