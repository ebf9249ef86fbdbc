"""Date and time Column functions (ANSI-safe ``try_`` forms throughout)."""

from __future__ import annotations

import datetime as dt
from typing import Union

from pyspark.sql import Column
from pyspark.sql import functions as F

DateLike = Union[str, dt.date, dt.datetime, None]

# Bucket thresholds in days (month above 180, week above 60).
MONTH_SPAN_DAYS = 180
WEEK_SPAN_DAYS = 60
DEFAULT_RANGE_DAYS = 365


def to_date_value(value: DateLike) -> dt.date | None:
    """Normalise a user bound (text, date or datetime) to a date."""
    if value is None or value == "":
        return None
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(str(value)[:10])


def date_from_parts(year: Column, month: Column, day: Column) -> Column:
    """``yyyy-MM-dd`` from parts; any null or impossible date gives null."""
    text = F.concat(
        year.cast("string"), F.lit("-"),
        F.lpad(month.cast("string"), 2, "0"), F.lit("-"),
        F.lpad(day.cast("string"), 2, "0"),
    )
    return F.try_to_date(text, "yyyy-MM-dd")


def hour_of(time_text: Column) -> Column:
    """Hour of an ``H:M:S`` text (one or two digits each); bad or missing → 0."""
    return F.coalesce(F.hour(F.try_to_timestamp(time_text, F.lit("H:m:s"))), F.lit(0)).cast("int")


def granularity(span_days: Column) -> Column:
    return (F.when(span_days > MONTH_SPAN_DAYS, F.lit("month"))
            .when(span_days > WEEK_SPAN_DAYS, F.lit("week"))
            .otherwise(F.lit("day")))


def period_start(date_col: Column, span_days: Column) -> Column:
    """Bucket start: month, week (Monday) or the day itself, chosen by span."""
    return (F.when(span_days > MONTH_SPAN_DAYS, F.trunc(date_col, "month"))
            .when(span_days > WEEK_SPAN_DAYS, F.date_trunc("week", date_col).cast("date"))
            .otherwise(date_col))


def default_range(as_of: DateLike = None) -> tuple[dt.date, dt.date]:
    """The picker default: the last 365 days up to ``as_of`` (today)."""
    end = to_date_value(as_of) or dt.date.today()
    return end - dt.timedelta(days=DEFAULT_RANGE_DAYS), end


def parse_datetime(text: Column) -> Column:
    """Text → TIMESTAMP_NTZ, null when unparseable (no session time zone)."""
    return text.try_cast("timestamp_ntz")


def format_datetime(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
