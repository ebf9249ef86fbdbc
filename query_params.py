"""Parameters of the registered queries, shared by the Spark side and the
DuckDB oracle so both ask the same question. The fixture's dates run from
2022-01-01 to 2023-12-31."""

from __future__ import annotations

import datetime as dt

# KPI / breakdown window: the first half of 2023.
KPI_RANGE = ("2023-01-01", "2023-06-30")
# Whole fixture.
FULL_RANGE = ("2022-01-01", "2023-12-31")
# ``as_of`` after the data, so the current-month cut removes nothing.
AS_OF_AFTER = "2024-06-15"
# ``as_of`` inside the data: rows from 2023-07-01 on are cut.
AS_OF_INSIDE = "2023-07-15"
WEEKLY_RANGE = ("2023-03-01", "2023-06-08")   # 99 days → weekly buckets
DAILY_RANGE = ("2023-05-01", "2023-05-30")    # 29 days → daily buckets

# Scan bounds as datetimes, and a row limit of a scan.
DATETIME_BOUNDS = (dt.datetime(2023, 2, 3, 15, 30), dt.datetime(2023, 4, 5, 6, 0))
SCAN_ROWS = 25

# Map filters.
NIGHT_HOURS = (22, 24)                 # → 22..23
DAY_HOURS = (6, 22)
TWO_CATEGORIES = ("PERSON", "SOCIETY")
ALL_CATEGORIES = ("PERSON", "PROPERTY", "SOCIETY")
THREE_AREAS = ("NATION_1", "NATION_5", "NATION_17")
# A U-shaped ring with one slanted edge, closed by repeating its first point.
POLYGON_U = ('{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [['
             '[-122.40, 47.52], [-122.26, 47.55], [-122.26, 47.70], [-122.30, 47.70], '
             '[-122.30, 47.58], [-122.36, 47.58], [-122.36, 47.70], [-122.40, 47.70], '
             '[-122.40, 47.52]]]}}')
CENTER = (47.6062, -122.3321)
RADIUS_DEFAULT_M = 805.0
RADIUS_WIDE_M = 3219.0
PAGE_AREA_TEXT = "NATION_1"            # free-text column filter: area contains …
HOT_DAY_ROWS = 300                     # latest rows asked of a table with one day
PAGE_NUMBER = 1                        # second page of 20

# Many-shape joins: circles around every block centroid, and four polygons
# (rectangle, the U above, a triangle, a diamond closed by its first point).
BLOCK_RADIUS_M = 805.0
POLYGONS = [
    (1, '{"type": "Polygon", "coordinates": [[[-122.42, 47.50], [-122.33, 47.50], [-122.33, 47.60], [-122.42, 47.60]]]}'),
    (2, POLYGON_U),
    (3, '{"type": "Polygon", "coordinates": [[[-122.30, 47.55], [-122.24, 47.71], [-122.41, 47.66]]]}'),
    (4, '{"type": "Polygon", "coordinates": [[[-122.33, 47.53], [-122.27, 47.61], [-122.33, 47.69], '
        '[-122.39, 47.61], [-122.33, 47.53]]]}'),
]
OUTLINE_RADIUS_M = 805.0

# Shapes of very different sizes in one join: radii by block, and boxes of 0.002, 0.1 and 10 degrees.
MIXED_RADII_M = (161.0, 805.0, 30000.0)


def _box(lon: float, lat: float, side: float) -> str:
    corners = [[lon, lat], [lon + side, lat], [lon + side, lat + side], [lon, lat + side]]
    return f'{{"type": "Polygon", "coordinates": [{corners}]}}'


POLYGONS_MIXED = [*POLYGONS, (5, _box(-122.3352, 47.6002, 0.002)), (6, _box(-122.3001, 47.5503, 0.002)),
                  (7, _box(-122.4, 47.55, 0.1)), (8, _box(-127.0, 42.0, 10.0))]
