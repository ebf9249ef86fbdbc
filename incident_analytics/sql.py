"""Spark SQL surface: temporary SQL functions and views.

``register(spark, gold_path=..., summary_path=...)`` creates SQL-bodied
temporary functions (inlined into plans like any built-in expression, no
Python at run time) and the views ``incidents`` / ``incident_daily``, so the
dashboard questions can be asked in plain Spark SQL, e.g.::

    SELECT area, count(*) AS n FROM incidents
    WHERE date BETWEEN DATE'2023-01-01' AND DATE'2023-06-30'
      AND haversine_m(47.6062D, -122.3321D, latitude, longitude) <= 805
    GROUP BY area

Each function has the same rule as its Column twin in ``functions``; the
tests compare them on random inputs.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .functions import dates, geo, text
from .operators.summary import read_summary
from .sources.gold import gold_table

RING_SQL_TYPE = "ARRAY<STRUCT<lon: DOUBLE, lat: DOUBLE>>"


def _function_ddl() -> list[str]:
    r = f"{geo.EARTH_RADIUS_M!r}D"
    s_lat = "sin((radians(lat2) - radians(lat1)) / 2)"
    s_lon = "sin((radians(lon2) - radians(lon1)) / 2)"
    return [
        f"""CREATE OR REPLACE TEMPORARY FUNCTION haversine_m(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE)
        RETURNS DOUBLE RETURN 2.0D * asin(sqrt(least({s_lat} * {s_lat}
            + cos(radians(lat1)) * cos(radians(lat2)) * ({s_lon} * {s_lon}), 1.0D))) * {r}""",
        f"""CREATE OR REPLACE TEMPORARY FUNCTION metres_to_miles(m DOUBLE)
        RETURNS DOUBLE RETURN m / {geo.METRES_PER_MILE!r}D""",
        f"""CREATE OR REPLACE TEMPORARY FUNCTION ring_from_geojson(g STRING)
        RETURNS {RING_SQL_TYPE} RETURN transform(
            try_element_at(coalesce(
                from_json(g, 'geometry STRUCT<coordinates: ARRAY<ARRAY<ARRAY<DOUBLE>>>>').geometry.coordinates,
                from_json(g, 'coordinates ARRAY<ARRAY<ARRAY<DOUBLE>>>').coordinates), 1),
            p -> named_struct('lon', p[0], 'lat', p[1]))""",
        f"""CREATE OR REPLACE TEMPORARY FUNCTION point_in_ring(lat DOUBLE, lon DOUBLE, ring {RING_SQL_TYPE})
        RETURNS BOOLEAN RETURN coalesce(aggregate(sequence(1, size(ring)), 0, (acc, i) -> acc + CASE WHEN
            lat > least(element_at(ring, i).lat, element_at(ring, i % size(ring) + 1).lat)
            AND lat <= greatest(element_at(ring, i).lat, element_at(ring, i % size(ring) + 1).lat)
            AND lon <= greatest(element_at(ring, i).lon, element_at(ring, i % size(ring) + 1).lon)
            AND element_at(ring, i).lat != element_at(ring, i % size(ring) + 1).lat
            AND (element_at(ring, i).lon = element_at(ring, i % size(ring) + 1).lon
                 OR lon <= try_divide((lat - element_at(ring, i).lat)
                      * (element_at(ring, i % size(ring) + 1).lon - element_at(ring, i).lon),
                      element_at(ring, i % size(ring) + 1).lat - element_at(ring, i).lat)
                    + element_at(ring, i).lon)
            THEN 1 ELSE 0 END) % 2 = 1, false)""",
        f"""CREATE OR REPLACE TEMPORARY FUNCTION period_start(d DATE, span_days INT)
        RETURNS DATE RETURN CASE WHEN span_days > {dates.MONTH_SPAN_DAYS} THEN trunc(d, 'month')
            WHEN span_days > {dates.WEEK_SPAN_DAYS} THEN CAST(date_trunc('week', d) AS DATE) ELSE d END""",
        f"""CREATE OR REPLACE TEMPORARY FUNCTION granularity(span_days INT)
        RETURNS STRING RETURN CASE WHEN span_days > {dates.MONTH_SPAN_DAYS} THEN 'month'
            WHEN span_days > {dates.WEEK_SPAN_DAYS} THEN 'week' ELSE 'day' END""",
        """CREATE OR REPLACE TEMPORARY FUNCTION hour_of(t STRING)
        RETURNS INT RETURN CAST(coalesce(hour(try_to_timestamp(t, 'H:m:s')), 0) AS INT)""",
        f"""CREATE OR REPLACE TEMPORARY FUNCTION truncate_label(s STRING)
        RETURNS STRING RETURN CASE WHEN length(s) > {text.LABEL_MAX}
            THEN concat(substring(s, 1, {text.LABEL_MAX}), '...') ELSE s END""",
        f"""CREATE OR REPLACE TEMPORARY FUNCTION address_key(a STRING)
        RETURNS STRING RETURN trim(regexp_replace(lower(CASE WHEN contains(lower(a), '{text.CITY_WORD}')
            THEN a ELSE concat(a, '{text.CITY_SUFFIX}') END), '\\\\s+', ' '))""",
    ]


def register(spark: SparkSession, gold_path: str | None = None, summary_path: str | None = None) -> None:
    """Create the temporary SQL functions, and the views ``incidents`` (gold
    table) and ``incident_daily`` (summary) for the paths given."""
    for ddl in _function_ddl():
        spark.sql(ddl)
    if gold_path:
        gold_table(spark, gold_path).createOrReplaceTempView("incidents")
    if summary_path:
        read_summary(spark, summary_path).createOrReplaceTempView("incident_daily")
