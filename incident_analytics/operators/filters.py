"""One filter state for every view: dates, hours, categories, areas, polygon, circle.

``IncidentFilter.condition()`` builds a single boolean Column, so Spark sees
one ``Filter``; simple range and equality parts reach the Parquet scan as
pushed filters (date bounds, hour range, ``IN`` lists, and the bounding boxes
put in front of the exact polygon and circle tests).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Optional, Sequence, Union

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.dates import DateLike, to_date_value

ALL_HOURS = (0, 24)


@dataclass(frozen=True)
class Circle:
    lat: float
    lon: float
    radius_m: Optional[float] = None  # None / 0 → default radius
    display_name: str = ""

    @property
    def radius(self) -> float:
        return float(self.radius_m) if self.radius_m else geo.DEFAULT_RADIUS_M


@dataclass(frozen=True)
class IncidentFilter:
    """Filter state.

    - ``start``/``end``: inclusive date bounds (``end_inclusive=False`` makes the
      end exclusive); ``None`` leaves the side open.
    - ``hours``: ``(start, end)`` inclusive, ``end`` capped at 23; ``(0, 24)`` or
      ``None`` is no filter; no wrap past midnight.
    - ``categories``: ``None`` is no filter; an empty list matches nothing; a
      single string is accepted.
    - ``areas``: ``None`` or empty is no filter; a single string is accepted.
    - ``polygon``: GeoJSON (text or dict) or a ring of ``[lon, lat]`` pairs.
    - ``circle``: centre and radius in metres.
    - ``require_coords``: keep only rows with both coordinates (every view does).
    """

    start: DateLike = None
    end: DateLike = None
    end_inclusive: bool = True
    hours: Optional[Sequence[int]] = None
    categories: Union[None, str, Sequence[str]] = None
    areas: Union[None, str, Sequence[str]] = None
    polygon: Union[None, str, dict, Sequence[Sequence[float]]] = None
    circle: Optional[Circle] = None
    require_coords: bool = True
    extra: Optional[Column] = field(default=None, compare=False)

    def date_condition(self) -> Column:
        cond = F.lit(True)
        start, end = to_date_value(self.start), to_date_value(self.end)
        if start is not None:
            cond = cond & (F.col("date") >= F.lit(start))
        if end is not None:
            cond = cond & ((F.col("date") <= F.lit(end)) if self.end_inclusive
                           else (F.col("date") < F.lit(end)))
        return cond

    def condition(self, summary: bool = False) -> Column:
        """The whole filter as one Column. ``summary``: for a daily summary
        table, where only date, category, area and coordinates apply."""
        if summary and (self.hours not in (None, ALL_HOURS, list(ALL_HOURS)) or self.polygon is not None
                        or self.circle is not None or self.extra is not None):
            raise ValueError("hour, polygon, circle and extra filters need the row-level table")
        cond = self.date_condition()
        if self.require_coords:
            cond = cond & (F.col("has_coords") if summary
                           else F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
        if self.hours is not None:
            lo, hi = int(self.hours[0]), int(self.hours[1])
            if (lo, hi) != ALL_HOURS:
                cond = cond & F.col("hour").between(lo, min(hi, 23))
        if self.categories is not None:
            cats = [self.categories] if isinstance(self.categories, str) else list(self.categories)
            cond = cond & (F.col("crime_against_category").isin(cats) if cats else F.lit(False))
        if self.areas:
            areas = [self.areas] if isinstance(self.areas, str) else list(self.areas)
            cond = cond & F.col("area").isin(areas)
        if self.polygon is not None:
            cond = cond & geo.in_polygon("latitude", "longitude", self.polygon)
        if self.circle is not None:
            c = self.circle
            cond = cond & geo.within_radius("latitude", "longitude", c.lat, c.lon, c.radius)
        if self.extra is not None:
            cond = cond & self.extra
        return cond

    def apply(self, df: DataFrame) -> DataFrame:
        """Filter ``df`` (row-level table or daily summary). On a
        year-partitioned table the date bounds are repeated as ``year``
        bounds, so whole partitions are pruned."""
        cond = self.condition(summary="n" in df.columns and "has_coords" in df.columns)
        if "year" in df.columns:
            start, end = to_date_value(self.start), to_date_value(self.end)
            if start is not None:
                cond = cond & (F.col("year") >= start.year)
            if end is not None:
                cond = cond & (F.col("year") <= end.year)
        return df.where(cond)
