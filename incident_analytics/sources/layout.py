"""Clustering order of gold rows by place and time.

Rows are numbered along a Z-order (Morton) curve over latitude, longitude, day of
the year and hour: each is cut into steps of equal width and the steps' bits are
interleaved, the place's twice as often as the time's. A run of the order, such
as a row group, then covers a small box of all four, and Parquet's own minima
and maxima let the scan skip the boxes that a circle, polygon, date or hour
filter does not meet.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The coordinates that cleaning keeps (README of the data).
LATITUDES, LONGITUDES = (47.0, 48.1), (-123.5, -121.0)
PLACE_BITS, DAY_BITS, HOUR_BITS, COARSE_BITS = 16, 6, 3, 5


def _step(value: Column, low: float, high: float, bits: int) -> Column:
    """Number of the step of equal width that a value falls in; beyond the ends
    the outer ones, null the first."""
    at = F.floor((value - F.lit(low)) / F.lit((high - low) / 2**bits))
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(2**bits - 1), at)), F.lit(0)).cast("bigint")


def curve_key(latitude: str = "latitude", longitude: str = "longitude", date: str = "date", hour: str = "hour") -> Column:
    """Place of a row on the curve, a bigint. Rounds of bits from the highest:
    latitude, longitude, then by turns a day or an hour bit while they last."""
    lat = _step(F.col(latitude), *LATITUDES, PLACE_BITS)
    lon = _step(F.col(longitude), *LONGITUDES, PLACE_BITS)
    day = _step(F.dayofyear(F.col(date)).cast("double"), 1.0, 367.0, DAY_BITS)
    clock = _step(F.col(hour).cast("double"), 0.0, 24.0, HOUR_BITS)
    order: list[tuple[Column, int]] = []
    days, hours = list(range(DAY_BITS - 1, -1, -1)), list(range(HOUR_BITS - 1, -1, -1))
    for bit in range(PLACE_BITS - 1, -1, -1):
        order += [(lat, bit), (lon, bit)]
        # the first bits tell parts of the whole box apart that are wider than a quarter of a city
        if bit < PLACE_BITS - COARSE_BITS and days:
            order.append((day, days.pop(0)))
        if bit < PLACE_BITS - COARSE_BITS and hours and len(days) % 2 == 0:
            order.append((clock, hours.pop(0)))
    key = F.lit(0).cast("bigint")
    for place, (column, bit) in enumerate(reversed(order)):
        key = key + F.shiftleft(F.shiftright(column, bit).bitwiseAND(F.lit(1)), place)
    return key
