"""DuckDB SQL twins of the registered queries (the correctness oracle).

Every statement starts from the same ``incidents`` derivation as
``incident_analytics.fixtures.incidents`` (FIXTURES.md), written in DuckDB's
dialect. Literal doubles are written in exponent form (``4.7e1``) because a
plain ``47.0`` is a DECIMAL in DuckDB.
"""

from __future__ import annotations

import json

import query_params as P

EARTH_RADIUS_M = 6371000.0
METRES_PER_MILE = 1609.34

INCIDENTS_SQL = """
SELECT e.event_id AS incident_id,
  CAST(DATE '2022-01-01' + CAST((e.event_id*37)%730 AS INTEGER) AS DATE) AS date,
  strftime(e.ts,'%H:%M:%S') AS time,
  CAST(hour(e.ts) AS INTEGER) AS hour,
  concat(CAST(CAST(DATE '2022-01-01' + CAST((e.event_id*37)%730 AS INTEGER) AS DATE) AS VARCHAR),' ',
         strftime(e.ts,'%H:%M:%S')) AS datetime,
  upper(e.event_type) AS offense,
  concat(upper(e.event_type),'_',
         CAST(TRY_CAST(json_extract_string(e.props,'$.k') AS INTEGER)%13 AS VARCHAR)) AS offense_sub_category,
  CASE WHEN e.event_type IN ('purchase','view') THEN 'PROPERTY'
       WHEN e.event_type IN ('error','click') THEN 'PERSON' ELSE 'SOCIETY' END AS crime_against_category,
  concat(CAST(e.event_id%97 AS VARCHAR),'XX BLOCK OF MAIN ST') AS location,
  n.n_name AS area, r.r_name AS precinct, substr(c.c_mktsegment,1,1) AS sector,
  CASE WHEN e.event_id%50=0 THEN NULL ELSE e.value END AS hazardness,
  CASE WHEN e.event_id%101=0 THEN NULL
       ELSE 4.74955e1 + ((e.event_id*7919)%61)*3.7e-3 + (e.event_id%3)*1e-5 END AS latitude,
  CASE WHEN e.event_id%103=0 THEN NULL
       ELSE -1.22435e2 + ((e.event_id*104729)%47)*4.3e-3 + (e.event_id%3)*1e-5 END AS longitude
FROM events e JOIN customer c ON e.user_id=c.c_custkey
     JOIN nation n ON c.c_nationkey=n.n_nationkey JOIN region r ON n.n_regionkey=r.r_regionkey
"""


def d(x: float) -> str:
    """A DOUBLE literal in both dialects."""
    text = repr(float(x))
    return text if ("e" in text or "inf" in text or "nan" in text) else f"{text}e0"


def with_incidents(body: str, extra_ctes: str = "") -> str:
    ctes = f"incidents AS ({INCIDENTS_SQL})"
    if extra_ctes:
        ctes += ",\n" + extra_ctes
    return f"WITH {ctes}\n{body}"


def date_cond(start, end) -> str:
    parts = ["latitude IS NOT NULL AND longitude IS NOT NULL"]
    if start:
        parts.append(f"date >= DATE '{start}'")
    if end:
        parts.append(f"date <= DATE '{end}'")
    return " AND ".join(parts)


def pct(part: str, total: str) -> str:
    return f"coalesce(CAST({part} AS DOUBLE) / NULLIF({total}, 0) * 1e2, 0e0)"


def kpis() -> str:
    s, e = P.KPI_RANGE
    return with_incidents(f"""
SELECT total, person, property, society,
  {pct('person', 'total')} AS person_pct,
  {pct('property', 'total')} AS property_pct,
  {pct('society', 'total')} AS society_pct
FROM (SELECT count(*) AS total,
        count(*) FILTER (WHERE crime_against_category = 'PERSON') AS person,
        count(*) FILTER (WHERE crime_against_category = 'PROPERTY') AS property,
        count(*) FILTER (WHERE crime_against_category = 'SOCIETY') AS society
      FROM incidents WHERE {date_cond(s, e)}) k
""")


COORDS = "latitude IS NOT NULL AND longitude IS NOT NULL"
CAT, SUB = "crime_against_category", "offense_sub_category"


def profile() -> str:
    return with_incidents(f"""
SELECT count(*) AS records,
  count(*) FILTER (WHERE {COORDS}) AS records_with_coords,
  min(date) AS min_date, max(date) AS max_date
FROM incidents""")


def selection_summary() -> str:
    s, e = P.KPI_RANGE
    return with_incidents(f"""
SELECT selected, total, {pct('selected', 'total')} AS selected_pct,
  CAST(datediff('day', DATE '{s}', DATE '{e}') AS INTEGER) AS days
FROM (SELECT count(*) FILTER (WHERE {date_cond(s, e)}) AS selected, count(*) AS total
      FROM incidents) x""")


def category_options() -> str:
    from incident_analytics.operators.options import CATEGORY_INFO, DEFAULT_COLOR
    labels = ", ".join(f"('{c}', '{l}', '{k}')" for c, l, k in CATEGORY_INFO)
    return with_incidents(f"""
SELECT c.category, coalesce(l.label, c.category) AS label, coalesce(l.color, '{DEFAULT_COLOR}') AS color
FROM cats c LEFT JOIN labels l ON c.category = l.category""", f"""
found AS (SELECT DISTINCT {CAT} AS category FROM incidents WHERE {COORDS} AND {CAT} IS NOT NULL),
cats AS (SELECT category FROM found
         UNION ALL SELECT category FROM (VALUES ('PERSON'), ('PROPERTY'), ('SOCIETY')) v(category)
         WHERE NOT EXISTS (SELECT 1 FROM found)),
labels AS (SELECT * FROM (VALUES {labels}) t(category, label, color))""")


def area_options() -> str:
    return with_incidents(f"SELECT DISTINCT area FROM incidents WHERE {COORDS} AND area IS NOT NULL")


def category_counts() -> str:
    s, e = P.KPI_RANGE
    return with_incidents(f"""
SELECT {CAT}, count(*) AS incidents FROM incidents
WHERE {date_cond(s, e)} AND {CAT} IS NOT NULL GROUP BY {CAT}""")


# Integers of at most 53 bits and their binary exponents: x = m * 2**k. A group's
# integers are added per band of eight exponents, as integers of the band's
# lowest unit, and the bands' sums from the largest band down.
HAZARD_PARTS_SQL = """
scored AS (SELECT *, CASE WHEN hazardness IS NULL OR isnan(hazardness) THEN 0e0 ELSE hazardness END AS x FROM base),
parted AS (SELECT *, CASE WHEN isinf(x) THEN CASE WHEN x > 0 THEN 1000 ELSE -1000 END WHEN x = 0 THEN 0
             ELSE CAST(floor(log2(abs(x)) / 8) AS INTEGER) END AS band FROM scored),
binned AS (SELECT * REPLACE (CAST(date AS DATE) AS date), CASE WHEN abs(band) = 1000 THEN CAST(1 AS HUGEINT)
             ELSE CAST(x * pow(2e0, (54 - 8 * band) // 2) * pow(2e0, (54 - 8 * band) - (54 - 8 * band) // 2) AS HUGEINT)
             END AS whole FROM parted)"""


def hazard_mean_sql(source: str, *keys: str) -> str:
    """Mean hazard per key, (keys, value), from the rows of ``binned``. (A cast of
    HUGEINT to DOUBLE may round twice; one of its text rounds once.)"""
    by = ", ".join(keys)
    return f"""(SELECT {by}, list_reduce(list_prepend(0e0, list(CASE WHEN total = 0 THEN 0e0
             WHEN abs(band) = 1000 THEN sign(band) * CAST('inf' AS DOUBLE)
             ELSE CAST(CAST(total AS VARCHAR) AS DOUBLE) * pow(2e0, (8 * band - 54) // 2) * pow(2e0, (8 * band - 54) - (8 * band - 54) // 2)
             END ORDER BY band DESC)), lambda a, b: a + b) / CAST(sum(n) AS DOUBLE) AS value
          FROM (SELECT {by}, band, sum(whole) AS total, count(*) AS n FROM {source} GROUP BY {by}, band) GROUP BY {by})"""


def trend_hazard_extreme() -> str:
    planted = """CASE WHEN incident_id % 397 = 0 THEN CAST('inf' AS DOUBLE) WHEN incident_id % 401 = 0 THEN CAST('-inf' AS DOUBLE)
      WHEN incident_id % 13 = 0 THEN CAST('nan' AS DOUBLE) WHEN incident_id % 11 = 0 THEN hazardness + 1e10
      WHEN incident_id % 7 = 0 THEN hazardness * 1e-300 WHEN incident_id % 5 = 0 AND incident_id % 3 = 0 THEN 1e300
      ELSE hazardness END"""
    return trend("hazard", "top", P.FULL_RANGE, P.AS_OF_AFTER, n=30).replace(
        "FROM incidents WHERE", f"FROM (SELECT * REPLACE ({planted} AS hazardness) FROM incidents) WHERE", 1)


def trend(metric: str, order: str, rng, as_of: str, n: int = 10) -> str:
    s, e = rng
    order_by = "metric DESC, area ASC" if order == "top" else "metric ASC, area DESC"
    if metric == "hazard":
        source, parts = "binned", HAZARD_PARTS_SQL + ","
        ranking = f"SELECT area, value AS metric FROM {hazard_mean_sql('binned', 'area')} WHERE area IS NOT NULL"
        values = f"SELECT * FROM {hazard_mean_sql('series', 'period', 'area')}"
    else:
        source, parts, count = "base", "", "CAST(count(*) AS DOUBLE)"
        ranking = f"SELECT area, {count} AS metric FROM base WHERE area IS NOT NULL GROUP BY area"
        values = f"SELECT period, area, {count} AS value FROM series GROUP BY period, area"
    return with_incidents(f"""
SELECT period, area, value,
  (SELECT CASE WHEN s > 180 THEN 'month' WHEN s > 60 THEN 'week' ELSE 'day' END FROM span) AS granularity
FROM ({values})""", f"""
base AS (SELECT * FROM incidents WHERE {date_cond(s, e)}
         AND date < CAST(date_trunc('month', DATE '{as_of}') AS DATE)),
span AS (SELECT datediff('day', min(date), max(date)) AS s FROM base),
{parts}
ranking AS ({ranking}),
chosen AS (SELECT area FROM ranking ORDER BY {order_by} LIMIT {n}),
series AS (
  SELECT CASE WHEN span.s > 180 THEN CAST(date_trunc('month', date) AS DATE)
              WHEN span.s > 60 THEN CAST(date_trunc('week', date) AS DATE)
              ELSE date END AS period,
         * EXCLUDE (date)
  FROM {source}, span WHERE area IN (SELECT area FROM chosen))""")


def category_breakdown(top: int = 10) -> str:
    s, e = P.KPI_RANGE
    return with_incidents(f"""
SELECT {CAT}, {SUB}, incidents, category_total, CAST(rank AS INTEGER) AS rank,
  greatest(9e-1 - (rank - 1) * 5e-2, 4e-1) AS opacity
FROM ranked WHERE rank <= {top}""", f"""
counts AS (SELECT {CAT}, {SUB}, count(*) AS incidents FROM incidents
           WHERE {date_cond(s, e)} AND {CAT} IS NOT NULL AND {SUB} IS NOT NULL GROUP BY {CAT}, {SUB}),
ranked AS (SELECT *, CAST(sum(incidents) OVER (PARTITION BY {CAT}) AS BIGINT) AS category_total,
             row_number() OVER (PARTITION BY {CAT} ORDER BY incidents DESC, {SUB} ASC) AS rank
           FROM counts)""")


def category_rollup() -> str:
    s, e = P.KPI_RANGE
    return with_incidents(f"""
SELECT {CAT}, {SUB}, CAST(GROUPING_ID({CAT}, {SUB}) AS INTEGER) AS level, count(*) AS incidents
FROM incidents WHERE {date_cond(s, e)} AND {CAT} IS NOT NULL AND {SUB} IS NOT NULL
GROUP BY ROLLUP ({CAT}, {SUB})""")


def subcategory_drilldown(category: str = "PERSON", top: int = 20, include_empty: bool = False) -> str:
    s, e = P.KPI_RANGE
    if include_empty:
        return with_incidents(f"""
SELECT {SUB}, CASE WHEN length({SUB}) > 40 THEN concat(substr({SUB}, 1, 40), '...') ELSE {SUB} END AS label,
  incidents, CAST(rank AS INTEGER) AS rank
FROM best WHERE rank <= {top}""", f"""
labels AS (SELECT DISTINCT {SUB} FROM incidents WHERE {date_cond(s, e)} AND {SUB} IS NOT NULL),
counts AS (SELECT {SUB}, count(*) AS incidents FROM incidents
           WHERE {date_cond(s, e)} AND {CAT} = '{category}' AND {SUB} IS NOT NULL GROUP BY {SUB}),
full_counts AS (SELECT l.{SUB}, coalesce(c.incidents, 0) AS incidents FROM labels l LEFT JOIN counts c USING ({SUB})),
best AS (SELECT *, row_number() OVER (ORDER BY incidents DESC, {SUB} ASC) AS rank FROM full_counts)""")
    return with_incidents(f"""
SELECT {SUB}, CASE WHEN length({SUB}) > 40 THEN concat(substr({SUB}, 1, 40), '...') ELSE {SUB} END AS label,
  incidents, CAST(rank AS INTEGER) AS rank
FROM best WHERE rank <= {top}""", f"""
counts AS (SELECT {SUB}, count(*) AS incidents FROM incidents
           WHERE {date_cond(s, e)} AND {CAT} = '{category}' AND {SUB} IS NOT NULL GROUP BY {SUB}),
best AS (SELECT *, row_number() OVER (ORDER BY incidents DESC, {SUB} ASC) AS rank FROM counts)""")


def haversine_sql(lat, lon, point_lat: str = "latitude", point_lon: str = "longitude") -> str:
    """Distance in metres from a centre (literal numbers or SQL text) to a point."""
    lat = d(lat) if isinstance(lat, float) else lat
    lon = d(lon) if isinstance(lon, float) else lon
    rl1, rn1 = f"radians({lat})", f"radians({lon})"
    s1 = f"sin((radians({point_lat}) - {rl1}) / 2)"
    s2 = f"sin((radians({point_lon}) - {rn1}) / 2)"
    a = f"{s1} * {s1} + cos({rl1}) * cos(radians({point_lat})) * ({s2} * {s2})"
    return f"(2e0 * asin(sqrt(least({a}, 1e0))) * {d(EARTH_RADIUS_M)})"


def polygon_sql(geojson: str) -> str:
    """Inside the closed box, and an odd number of edges at or right of the point at its latitude."""
    shape = json.loads(geojson)
    ring = shape.get("geometry", shape)["coordinates"][0]
    lons, lats = zip(*ring)
    crossings = []
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if y1 == y2:
            continue
        reach = f"longitude <= {d(x1)}" if x1 == x2 else (
            f"longitude <= {d(max(x1, x2))} AND longitude <= (latitude - {d(y1)}) * {d(x2 - x1)} / {d(y2 - y1)} + {d(x1)}")
        crossings.append(f"CAST(latitude > {d(min(y1, y2))} AND latitude <= {d(max(y1, y2))} AND {reach} AS INTEGER)")
    return (f"(latitude BETWEEN {d(min(lats))} AND {d(max(lats))} AND longitude BETWEEN {d(min(lons))} AND {d(max(lons))}"
            f" AND ({' + '.join(crossings) or '0'}) % 2 = 1)")


def filter_sql(rng, hours=None, categories=None, areas=None, polygon=None, circle=None) -> str:
    parts = [date_cond(*rng)]
    if hours is not None and tuple(hours) != (0, 24):
        parts.append(f"hour BETWEEN {hours[0]} AND {min(hours[1], 23)}")
    if categories is not None:
        parts.append(f"{CAT} IN ({', '.join(repr(c) for c in categories)})" if categories else "FALSE")
    if areas:
        parts.append(f"area IN ({', '.join(repr(a) for a in areas)})")
    if polygon is not None:
        parts.append(polygon_sql(polygon))
    if circle is not None:
        (lat, lon), r = circle
        parts.append(f"{haversine_sql(lat, lon)} <= {d(r)}")
    return " AND ".join(parts)


ROW_COLS = f"incident_id, date, hour, {CAT}, area, latitude, longitude"


def filtered_rows(**kw) -> str:
    return with_incidents(f"SELECT {ROW_COLS} FROM incidents WHERE {filter_sql(P.FULL_RANGE, **kw)}")


def circle_rows() -> str:
    cond = filter_sql(P.FULL_RANGE, circle=(P.CENTER, P.RADIUS_DEFAULT_M))
    return with_incidents(f"""
SELECT {ROW_COLS}, round({haversine_sql(*P.CENTER)}, 3) AS distance_m
FROM incidents WHERE {cond}""")


DETAIL_COND = dict(hours=P.DAY_HOURS, categories=P.ALL_CATEGORIES, circle=(P.CENTER, P.RADIUS_WIDE_M))


def details_cte() -> str:
    return f"""
rows AS (SELECT *, TRY_CAST(datetime AS TIMESTAMP) AS ts FROM incidents
         WHERE {filter_sql(P.FULL_RANGE, **DETAIL_COND)}),
latest AS (SELECT * FROM rows ORDER BY ts DESC NULLS LAST, incident_id ASC LIMIT 500),
details AS (SELECT incident_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date_time,
              {SUB} AS offense_type, {CAT} AS crime_against, location, area,
              round_even(hazardness, 1) AS hazard_score FROM latest)"""


def incident_details() -> str:
    return with_incidents("SELECT * FROM details", details_cte())


def details_page() -> str:
    return with_incidents(f"""
SELECT * FROM details WHERE contains(area, '{P.PAGE_AREA_TEXT}')
ORDER BY hazard_score DESC NULLS LAST, date_time DESC NULLS LAST, incident_id ASC
LIMIT 20 OFFSET {20 * P.PAGE_NUMBER}""", details_cte())


MAP_COND = dict(hours=(0, 24), categories=P.ALL_CATEGORIES)


def shown_cte(n: int = 5000) -> str:
    return f"""
shown AS (SELECT * FROM incidents WHERE {filter_sql(P.FULL_RANGE, **MAP_COND)}
          ORDER BY date DESC NULLS LAST, incident_id ASC LIMIT {n})"""


def map_points() -> str:
    return with_incidents(f"""
SELECT incident_id, date, {CAT}, coalesce({SUB}, 'Unknown') AS hover_text, latitude, longitude,
  location_freq,
  CASE WHEN mx > mn THEN 5e0 + (location_freq - mn) / (mx - mn) * 2e1 ELSE 8e0 END AS marker_size
FROM m""", shown_cte() + f""",
f AS (SELECT *, count(*) OVER (PARTITION BY round_even(latitude, 4), round_even(longitude, 4))
        AS location_freq FROM shown),
m AS (SELECT *, min(location_freq) OVER () AS mn, max(location_freq) OVER () AS mx FROM f)""")


HOT_DAY = "DATE '2023-06-01'"


def details_hot_day() -> str:
    return with_incidents(f"""
SELECT incident_id, concat('2023-06-01 ', time) AS date_time, {SUB} AS offense_type, {CAT} AS crime_against,
  location, area, round_even(hazardness, 1) AS hazard_score
FROM (SELECT * FROM incidents WHERE {COORDS} ORDER BY time DESC, incident_id ASC LIMIT {P.HOT_DAY_ROWS})""")


def map_points_hot_day() -> str:
    return with_incidents(f"""
SELECT incident_id, {HOT_DAY} AS date, {CAT}, coalesce({SUB}, 'Unknown') AS hover_text, latitude, longitude,
  location_freq, CASE WHEN mx > mn THEN 5e0 + (location_freq - mn) / (mx - mn) * 2e1 ELSE 8e0 END AS marker_size
FROM m""", f"""
shown AS (SELECT * FROM incidents WHERE {COORDS} ORDER BY incident_id ASC LIMIT {P.HOT_DAY_ROWS}),
f AS (SELECT *, count(*) OVER (PARTITION BY round_even(latitude, 4), round_even(longitude, 4)) AS location_freq FROM shown),
m AS (SELECT *, min(location_freq) OVER () AS mn, max(location_freq) OVER () AS mx FROM f)""")


def map_stats(n: int = 5000) -> str:
    return with_incidents(f"""
SELECT {CAT}, count(*) AS points,
  least((SELECT c FROM matching), CAST({n} AS BIGINT)) AS shown_total,
  (SELECT c FROM matching) AS matching_total
FROM shown GROUP BY {CAT}""", shown_cte(n) + f""",
matching AS (SELECT count(*) AS c FROM incidents WHERE {filter_sql(P.FULL_RANGE, **MAP_COND)})""")


def _fault_sql(col_sql: str, cases) -> str:
    whens = " ".join(
        f"WHEN incident_id % {m} = 0 THEN {'NULL' if v is None else repr(v)}" for m, v in cases)
    return f"CASE {whens} ELSE {col_sql} END"


def raw_cte() -> str:
    """The raw fixture (planted faults) in DuckDB; mirrors fixtures.raw_incidents."""
    from incident_analytics.fixtures import DATE_FAULTS, RAW_FAULTS, SHOOTING_RESIDUE
    from incident_analytics.schema import RAW_COLUMNS
    day = "CAST(date AS VARCHAR)"
    planted = {
        "null": "NULL",
        "feb30": "CAST(year(date) AS VARCHAR) || '-02-30 ' || time",
        "hour25": f"{day} || ' 25:00:00'",
        "no_time": day,
        "9:05:00": f"{day} || ' 9:05:00'",
        "09:5:1": f"{day} || ' 09:5:1'",
    }
    od = "CASE " + " ".join(f"WHEN incident_id % {m} = 0 THEN {planted[k]}" for m, k in DATE_FAULTS)
    od += f" ELSE {day} || ' ' || time END"
    source = {
        "Offense Category": "offense",
        "Offense Sub Category": SUB,
        "NIBRS Crime Against Category": CAT,
        "Block Address": "location",
        "Neighborhood": "area",
        "Precinct": "precinct",
        "Sector": "sector",
        "Beat": "sector || CAST(incident_id % 3 + 1 AS VARCHAR)",
        "Reporting Area": "CAST(incident_id % 900 AS VARCHAR)",
        "Hazardness": "CAST(hazardness AS VARCHAR)",
        "Latitude": "CAST(latitude AS VARCHAR)",
        "Longitude": "CAST(longitude AS VARCHAR)",
    }
    cols = {name: _fault_sql(expr, RAW_FAULTS[name]) for name, expr in source.items()}
    cols["Offense Date"] = od
    cols["Shooting Type Group"] = f"CASE WHEN incident_id % {SHOOTING_RESIDUE} = 0 THEN 'Non-Fatal' END"
    body = ",\n  ".join(f'{cols[c]} AS "{c}"' for c in RAW_COLUMNS)
    return f"raw AS (SELECT incident_id,\n  {body}\nFROM incidents)"


def clean_ctes() -> str:
    """raw → std (C1) → num (C2) → kept (C3–C8) → cleaned."""
    from incident_analytics.operators import clean as C
    from incident_analytics.schema import RAW_COLUMNS
    ph = ", ".join(repr(p) for p in C.PLACEHOLDERS)
    std = ", ".join(f'CASE WHEN "{c}" IN ({ph}) THEN NULL ELSE "{c}" END AS "{c}"' for c in RAW_COLUMNS)
    keep = " AND ".join(f"({v})" for v in keep_sql().values())
    od = '"Offense Date"'
    return raw_cte() + f""",
std AS (SELECT incident_id, {std} FROM raw),
num AS (SELECT * REPLACE (TRY_CAST("Latitude" AS DOUBLE) AS "Latitude",
                          TRY_CAST("Longitude" AS DOUBLE) AS "Longitude") FROM std),
kept AS (SELECT * FROM num WHERE {keep}),
parts AS (SELECT *,
    TRY_CAST(split_part(split_part({od}, ' ', 1), '-', 1) AS INTEGER) AS y,
    TRY_CAST(split_part(split_part({od}, ' ', 1), '-', 2) AS INTEGER) AS m,
    TRY_CAST(split_part(split_part({od}, ' ', 1), '-', 3) AS INTEGER) AS d,
    NULLIF(split_part({od}, ' ', 2), '') AS t FROM kept),
dated AS (SELECT *, TRY_CAST(CAST(y AS VARCHAR) || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-'
                            || lpad(CAST(d AS VARCHAR), 2, '0') AS DATE) AS dte FROM parts),
cleaned AS (SELECT incident_id, dte AS date, t AS time,
    CAST(coalesce(hour(try_strptime(t, '%H:%M:%S')), 0) AS INTEGER) AS hour,
    CAST(dte AS VARCHAR) || ' ' || t AS datetime,
    "Offense Category" AS offense, "Offense Sub Category" AS {SUB},
    "NIBRS Crime Against Category" AS {CAT}, "Block Address" AS location,
    "Neighborhood" AS area, "Precinct" AS precinct, "Sector" AS sector,
    TRY_CAST("Hazardness" AS DOUBLE) AS hazardness, "Latitude" AS latitude, "Longitude" AS longitude
  FROM dated)"""


def keep_sql() -> dict[str, str]:
    from incident_analytics.operators import clean as C

    def lst(xs):
        return ", ".join(repr(x) for x in xs)
    req = " AND ".join(f'"{c}" IS NOT NULL' for c in C.REQUIRED)
    return {
        "c3_coordinate_range": (f'"Latitude" BETWEEN {d(C.LAT_RANGE[0])} AND {d(C.LAT_RANGE[1])} AND '
                                f'"Longitude" BETWEEN {d(C.LON_RANGE[0])} AND {d(C.LON_RANGE[1])}'),
        "c4_neighborhood": f'"Neighborhood" IS NOT NULL AND "Neighborhood" NOT IN ({lst(C.BAD_AREAS)})',
        "c5_category": f'"NIBRS Crime Against Category" IN ({lst(C.VALID_CATEGORIES)})',
        "c6_sub_category": (f'"Offense Sub Category" IS NOT NULL AND '
                            f'"Offense Sub Category" NOT IN ({lst(C.BAD_SUBCATEGORIES)})'),
        "c7_required": req,
        "c8_sector": f'"Sector" IS NOT NULL AND "Sector" NOT IN ({lst(C.BAD_SECTORS)})',
    }


GOLD_SELECT = ("incident_id, date, time, hour, datetime, offense, offense_sub_category, "
               "crime_against_category, location, area, precinct, sector, hazardness, latitude, longitude")


def clean_incidents() -> str:
    return with_incidents(f"SELECT {GOLD_SELECT} FROM cleaned", clean_ctes())


def summary_append_replay() -> str:
    """KPIs over the cleaned rows."""
    text = kpis()
    head, body = text.split("\nSELECT total", 1)
    return with_incidents("SELECT total" + body.replace("FROM incidents WHERE", "FROM cleaned WHERE"), clean_ctes())


def curve_layout_filter() -> str:
    circle = filter_sql(P.FULL_RANGE, circle=(P.CENTER, P.RADIUS_DEFAULT_M))
    return with_incidents(f"""
SELECT 'circle' AS shape, {ROW_COLS} FROM incidents WHERE {circle}
UNION ALL SELECT 'polygon', {ROW_COLS} FROM incidents WHERE {filter_sql(P.FULL_RANGE, polygon=P.POLYGON_U)}""")


def clean_audit() -> str:
    from incident_analytics.operators import clean as C
    from incident_analytics.schema import RAW_COLUMNS
    ph = ", ".join(repr(p) for p in C.PLACEHOLDERS)
    any_ph = " OR ".join(f'coalesce("{c}" IN ({ph}), FALSE)' for c in RAW_COLUMNS)
    rules = keep_sql()
    keep_all = " AND ".join(f"({v})" for v in rules.values())
    od = '"Offense Date"'
    t = f"NULLIF(split_part({od}, ' ', 2), '')"
    dpart = f"split_part({od}, ' ', 1)"
    dte = (f"TRY_CAST(CAST(TRY_CAST(split_part({dpart}, '-', 1) AS INTEGER) AS VARCHAR) || '-' || "
           f"lpad(CAST(TRY_CAST(split_part({dpart}, '-', 2) AS INTEGER) AS VARCHAR), 2, '0') || '-' || "
           f"lpad(CAST(TRY_CAST(split_part({dpart}, '-', 3) AS INTEGER) AS VARCHAR), 2, '0') AS DATE)")
    metrics = {
        "rows_in": "count(*)",
        "c1_placeholder_rows": "count(*) FILTER (WHERE ph)",
        "c2_unparseable_coordinates": ('count(*) FILTER (WHERE (lat_text IS NOT NULL AND "Latitude" IS NULL) '
                                       'OR (lon_text IS NOT NULL AND "Longitude" IS NULL))'),
        **{k: f"count(*) FILTER (WHERE NOT coalesce(({v}), FALSE))" for k, v in rules.items()},
        "c9_shooting_filled": 'count(*) FILTER (WHERE "Shooting Type Group" IS NULL)',
        "p1_bad_date": f"count(*) FILTER (WHERE {dte} IS NULL)",
        "p3_hour_defaulted": f"count(*) FILTER (WHERE hour(try_strptime({t}, '%H:%M:%S')) IS NULL)",
        "rows_out": f"count(*) FILTER (WHERE coalesce(({keep_all}), FALSE))",
    }
    wide = ", ".join(f"{v} AS {k}" for k, v in metrics.items())
    long = " UNION ALL ".join(f"SELECT '{k}' AS rule, {k} AS rows FROM wide" for k in metrics)
    std = ", ".join(f'CASE WHEN "{c}" IN ({ph}) THEN NULL ELSE "{c}" END AS "{c}"' for c in RAW_COLUMNS)
    return with_incidents(long, raw_cte() + f""",
flag AS (SELECT *, ({any_ph}) AS ph FROM raw),
std AS (SELECT incident_id, ph, {std} FROM flag),
num AS (SELECT * REPLACE (TRY_CAST("Latitude" AS DOUBLE) AS "Latitude",
                          TRY_CAST("Longitude" AS DOUBLE) AS "Longitude"),
          "Latitude" AS lat_text, "Longitude" AS lon_text FROM std),
wide AS (SELECT {wide} FROM num)""")


def load_audit() -> str:
    """The audit of the export; every row of it fits its header."""
    return clean_audit() + " UNION ALL SELECT 'unreadable_rows' AS rule, 0 AS rows"


def load_rejects() -> str:
    rules = keep_sql()
    names = ", ".join(f"CASE WHEN NOT coalesce(({v}), FALSE) THEN '{k}' END" for k, v in rules.items())
    keep = " AND ".join(f"({v})" for v in rules.values())
    return with_incidents(f"""
SELECT incident_id, concat_ws(',', {names}) AS failed, offense_text
FROM num JOIN (SELECT incident_id AS raw_id, "Offense Category" AS offense_text FROM raw) r ON num.incident_id = raw_id
WHERE NOT coalesce(({keep}), FALSE)""", clean_ctes())


def ingest_profile() -> str:
    return with_incidents(f"""
SELECT count(*) AS records, count(*) FILTER (WHERE {COORDS}) AS records_with_coords,
  min(date) AS min_date, max(date) AS max_date FROM cleaned""", clean_ctes())


def schema_report() -> str:
    from incident_analytics.schema import INCIDENTS
    want = [f.name for f in INCIDENTS.fields]
    parts = [f"SELECT '{c}' AS column_name, 'ok' AS status, {i} AS position, count({c}) AS non_null FROM cleaned"
             for i, c in enumerate(want)]
    parts.append(f"SELECT 'year' AS column_name, 'extra' AS status, {2 * len(want)} AS position, "
                 "count(year(date)) AS non_null FROM cleaned")
    return with_incidents(" UNION ALL ".join(parts), clean_ctes())


def exact_mean_sql(col: str) -> str:
    return f"CAST(sum(CAST(CAST({col} AS VARCHAR) AS DECIMAL(28,18))) AS DOUBLE) / CAST(count({col}) AS DOUBLE)"


def radius_join(radius: str = d(P.BLOCK_RADIUS_M)) -> str:
    return with_incidents(f"""
SELECT c.center_id, count(*) AS incidents,
  count(*) FILTER (WHERE p.{CAT} = 'PERSON') AS person,
  count(*) FILTER (WHERE p.{CAT} = 'PROPERTY') AS property,
  count(*) FILTER (WHERE p.{CAT} = 'SOCIETY') AS society
FROM centers c, pts p
WHERE {haversine_sql('c.center_lat', 'c.center_lon', 'p.latitude', 'p.longitude')} <= c.radius_m
GROUP BY c.center_id""", f"""
pts AS (SELECT * FROM incidents WHERE {date_cond(*P.FULL_RANGE)}),
centers AS (SELECT location AS center_id, {exact_mean_sql('latitude')} AS center_lat,
              {exact_mean_sql('longitude')} AS center_lon, {radius} AS radius_m
            FROM pts WHERE location IS NOT NULL GROUP BY location)""")


def radius_join_hot_cell() -> str:
    moved = "incident_id % 3 = 0 AND latitude IS NOT NULL AND longitude IS NOT NULL"
    return radius_join().replace("FROM incidents", f"""FROM (SELECT * REPLACE (
  CASE WHEN {moved} THEN {d(P.CENTER[0])} ELSE latitude END AS latitude,
  CASE WHEN {moved} THEN {d(P.CENTER[1])} ELSE longitude END AS longitude) FROM incidents) moved""", 1)


def radius_join_mixed() -> str:
    small, middle, large = map(d, P.MIXED_RADII_M)
    block = "CAST(regexp_extract(location, '^([0-9]+)', 1) AS INTEGER) % 3"
    return radius_join(f"CASE {block} WHEN 0 THEN {small} WHEN 1 THEN {middle} ELSE {large} END")


def polygon_join(polygons=P.POLYGONS) -> str:
    parts = " UNION ALL ".join(
        f"SELECT {pid} AS polygon_id, count(*) FILTER (WHERE {polygon_sql(gj)}) AS incidents FROM pts"
        for pid, gj in polygons)
    return with_incidents(f"SELECT polygon_id, incidents FROM ({parts}) x WHERE incidents > 0",
                          f"pts AS (SELECT * FROM incidents WHERE {date_cond(*P.FULL_RANGE)})")


def _key_sql(col: str) -> str:
    city = f"CASE WHEN contains(lower({col}), 'seattle') THEN {col} ELSE {col} || ', Seattle, WA' END"
    return f"trim(regexp_replace(lower({city}), '\\s+', ' ', 'g'))"


def gazetteer_ctes() -> str:
    return f"""
gpts AS (SELECT * FROM incidents WHERE {COORDS} AND location IS NOT NULL),
gaz AS (SELECT location AS address, {exact_mean_sql('latitude')} AS lat, {exact_mean_sql('longitude')} AS lon,
          count(*) AS hits, concat_ws(', ', location, area, 'Seattle, WA') AS display_name
        FROM gpts GROUP BY location, area),
gk AS (SELECT *, {_key_sql('address')} AS key FROM gaz),
best AS (SELECT key, lat, lon, display_name FROM (
           SELECT *, row_number() OVER (PARTITION BY key ORDER BY hits DESC, display_name ASC) AS rn FROM gk)
         WHERE rn = 1)"""


def geocode_lookup() -> str:
    return with_incidents(f"""
SELECT a.address, b.lat AS latitude, b.lon AS longitude, b.display_name
FROM addrs a LEFT JOIN best b ON {_key_sql('a.address')} = b.key""", gazetteer_ctes() + """,
locs AS (SELECT DISTINCT location FROM incidents WHERE location IS NOT NULL),
addrs AS (SELECT location AS address FROM locs
          UNION ALL SELECT location || ', Seattle, WA' FROM locs
          UNION ALL SELECT location || ' annex' FROM locs)""")


def _words_sql(col: str) -> str:
    """The sorted distinct words of the fixture's addresses (SURVEY J6; those of
    its typed ones: abbreviations, fillers, unit, postal code, house number)."""
    text = f"regexp_replace(lower({col}), '\\b(apt|unit|suite|ste)\\b\\.?\\s*[0-9a-z-]*', ' ', 'g')"
    words = f"list_filter(string_split_regex({text}, '[^0-9a-z]+'), lambda w: w NOT IN ('', 'block', 'of', 'seattle', 'wa', '98101'))"
    return (f"list_sort(list_distinct(list_transform({words}, lambda w: CASE WHEN w = 'st' THEN 'street' WHEN w = 'ave' THEN 'avenue' "
            "WHEN regexp_full_match(w, '[0-9]+') THEN CAST(CAST(w AS BIGINT) // 100 AS VARCHAR) || 'xx' ELSE w END)))")


def geocode_free_text() -> str:
    """Every typed address against every entry's words: one word at most may
    differ, by one letter missing, added, changed or moved."""
    shorter = "list_transform(range(1, length({0}) + 1), lambda k: substr({0}, 1, k - 1) || substr({0}, k + 1))"
    p, q = "(qw[1])", "(gw[1])"
    moved = (f"(length({p}) = length({q}) AND list_sort(string_split({p}, '')) = list_sort(string_split({q}, '')) "
             f"AND list_has_any({shorter.format(p)}, {shorter.format(q)}))")
    return with_incidents(f"""
SELECT a.address, h.lat AS latitude, h.lon AS longitude, h.display_name, h.typos
FROM typed a LEFT JOIN ranked h ON {_words_sql('a.address')} = h.q AND h.rn = 1""", gazetteer_ctes() + f""",
locs AS (SELECT DISTINCT location, regexp_extract(location, '^([0-9]+)XX', 1) || '07' AS house,
           regexp_replace(regexp_extract(location, '^[0-9]+XX BLOCK OF (.*)$', 1), ' ST$', '') AS street
         FROM incidents WHERE location IS NOT NULL),
typed AS (SELECT house || ' ' || street || ' Street, Seattle WA 98101' AS address FROM locs
  UNION ALL SELECT street || ' st. ' || house FROM locs
  UNION ALL SELECT house || ' ' || substr(street, 2) || ' st' FROM locs
  UNION ALL SELECT house || ' ' || substr(street, 2, 1) || substr(street, 1, 1) || substr(street, 3) || ' st, apt 4' FROM locs
  UNION ALL SELECT house || ' X' || substr(street, 2) || ' st' FROM locs
  UNION ALL SELECT house || ' Elsewhere Ave' FROM locs),
asked AS (SELECT DISTINCT {_words_sql('address')} AS q FROM typed),
named AS (SELECT *, {_words_sql('address')} AS g FROM gaz),
sets AS (SELECT g, arg_min(ROW(lat, lon, display_name, hits), ROW(-hits, display_name)) AS hit FROM named GROUP BY g),
differ AS (SELECT q, hit, list_filter(q, lambda w: NOT list_contains(g, w)) AS qw,
             list_filter(g, lambda w: NOT list_contains(q, w)) AS gw FROM asked, sets),
close AS (SELECT q, hit, CAST(length(qw) AS INTEGER) AS typos FROM differ
          WHERE (length(qw) = 0 AND length(gw) = 0) OR (length(qw) = 1 AND length(gw) = 1
            AND regexp_full_match({p}, '[a-z]{{3,}}') AND regexp_full_match({q}, '[a-z]{{3,}}')
            AND (levenshtein({p}, {q}) <= 1 OR {moved}))),
ranked AS (SELECT q, typos, hit[1] AS lat, hit[2] AS lon, hit[3] AS display_name,
             row_number() OVER (PARTITION BY q ORDER BY typos, -hit[4], hit[3]) AS rn FROM close)""")


def circle_outline() -> str:
    ang = "(6.283185307179586e0 * t.i / 64e0)"
    return with_incidents(f"""
SELECT key, display_name, radius_m, CAST(t.i AS INTEGER) AS point,
  lat + (radius_m / 1.11e5) * cos({ang}) AS latitude,
  lon + (radius_m / (1.11e5 * cos(radians(lat)))) * sin({ang}) AS longitude,
  radius_m / {d(METRES_PER_MILE)} AS radius_miles
FROM (SELECT *, {d(P.OUTLINE_RADIUS_M)} AS radius_m FROM best) c CROSS JOIN range(0, 65) t(i)""",
                          gazetteer_ctes())


def location_frequency() -> str:
    return with_incidents(f"""
SELECT round_even(latitude, 4) AS lat4, round_even(longitude, 4) AS lon4, count(*) AS incidents
FROM incidents WHERE {filter_sql(P.FULL_RANGE, **MAP_COND)} GROUP BY 1, 2""")


PYRAMID_COND = dict(hours=P.DAY_HOURS, categories=P.TWO_CATEGORIES)


def location_frequency_from_pyramid() -> str:
    return with_incidents(f"""
SELECT round_even(latitude, 4) AS lat4, round_even(longitude, 4) AS lon4, count(*) AS incidents
FROM incidents WHERE {filter_sql(P.KPI_RANGE, **PYRAMID_COND)} GROUP BY 1, 2""")


def map_totals_from_pyramid() -> str:
    return with_incidents(f"""
SELECT {CAT}, count(*) AS matching, CAST(sum(count(*)) OVER () AS BIGINT) AS matching_total,
  CAST(least(sum(count(*)) OVER (), 5000) AS BIGINT) AS shown_total
FROM incidents WHERE {filter_sql(P.KPI_RANGE, **PYRAMID_COND)} GROUP BY {CAT}""")


def density_from_pyramid(level: int = 8) -> str:
    def corner(c):
        return f"floor(round(round_even({c}, 4) * 1e4) / {2.0**level}) / {d(1e4 / 2**level)}"
    return with_incidents(f"""
SELECT {corner('latitude')} AS latitude, {corner('longitude')} AS longitude, count(*) AS incidents
FROM incidents WHERE {filter_sql(P.KPI_RANGE, **PYRAMID_COND)} GROUP BY 1, 2""")


def kpis_default_range() -> str:
    s, e = P.KPI_RANGE
    return kpis().replace(date_cond(s, e), f"{COORDS} AND date BETWEEN DATE '{P.AS_OF_INSIDE}' - 365 AND DATE '{P.AS_OF_INSIDE}'")


def scan_datetime_bounds() -> str:
    low, high = (t.date().isoformat() for t in P.DATETIME_BOUNDS)
    return with_incidents(f"SELECT {GOLD_SELECT} FROM cleaned WHERE date BETWEEN DATE '{low}' AND DATE '{high}'", clean_ctes())


def scan_limit() -> str:
    return with_incidents(f"SELECT least(count(*), {P.SCAN_ROWS}) AS records, least(count(*), {P.SCAN_ROWS}) AS ids "
                          "FROM cleaned", clean_ctes())


def smoke_row() -> str:
    return with_incidents("SELECT least(count(*), 1) AS records, least(count(*), 1) AS with_coords FROM cleaned", clean_ctes())


def geocoder_reply() -> str:
    number = "CAST(regexp_extract(key, '^([0-9]+)', 1) AS INTEGER)"
    none = f"({number} % 7 = 0 OR {number} % 11 = 0)"
    return with_incidents(f"""
SELECT key, CASE WHEN {none} THEN NULL ELSE lat END AS lat, CASE WHEN {none} THEN NULL ELSE lon END AS lon,
  CASE WHEN {none} THEN NULL ELSE display_name END AS display_name
FROM best""", gazetteer_ctes())


def all_sql() -> dict[str, str]:
    return {
        "kpis": kpis(),
        "profile": profile(),
        "selection_summary": selection_summary(),
        "category_options": category_options(),
        "area_options": area_options(),
        "category_counts": category_counts(),
        "trend_count_top": trend("count", "top", P.FULL_RANGE, P.AS_OF_AFTER),
        "trend_count_bottom": trend("count", "bottom", P.FULL_RANGE, P.AS_OF_AFTER),
        "trend_hazard_top": trend("hazard", "top", P.FULL_RANGE, P.AS_OF_AFTER),
        "trend_hazard_bottom": trend("hazard", "bottom", P.FULL_RANGE, P.AS_OF_AFTER),
        "trend_hazard_extreme": trend_hazard_extreme(),
        "trend_weekly": trend("count", "top", P.WEEKLY_RANGE, P.AS_OF_AFTER),
        "trend_daily": trend("hazard", "top", P.DAILY_RANGE, P.AS_OF_AFTER),
        "trend_month_cut": trend("count", "top", P.FULL_RANGE, P.AS_OF_INSIDE),
        "category_breakdown": category_breakdown(),
        "category_rollup": category_rollup(),
        "subcategory_drilldown": subcategory_drilldown(),
        "subcategory_drilldown_with_empty": subcategory_drilldown("SOCIETY", include_empty=True),
        "hour_filter": filtered_rows(hours=P.NIGHT_HOURS),
        "category_filter": filtered_rows(categories=P.TWO_CATEGORIES),
        "area_filter": filtered_rows(areas=P.THREE_AREAS),
        "polygon_filter": filtered_rows(polygon=P.POLYGON_U),
        "circle_filter": circle_rows(),
        "incident_details": incident_details(),
        "details_page": details_page(),
        "map_points": map_points(),
        "details_hot_day": details_hot_day(),
        "map_points_hot_day": map_points_hot_day(),
        "map_stats": map_stats(),
        "location_frequency": location_frequency(),
        "location_frequency_from_pyramid": location_frequency_from_pyramid(),
        "map_totals_from_pyramid": map_totals_from_pyramid(),
        "density_from_pyramid": density_from_pyramid(),
        "details_keyset_page": details_page(),
        "kpis_default_range": kpis_default_range(),
        "scan_datetime_bounds": scan_datetime_bounds(),
        "scan_limit": scan_limit(),
        "smoke_row": smoke_row(),
        "geocoder_reply": geocoder_reply(),
        "clean_incidents": clean_incidents(),
        "clean_audit": clean_audit(),
        "ingest_roundtrip": clean_incidents(),
        "ingest_stream": clean_incidents(),
        "ingest_append_replay": clean_incidents(),
        "summary_append_replay": summary_append_replay(),
        "load_audit": load_audit(),
        "load_rejects": load_rejects(),
        "curve_layout_filter": curve_layout_filter(),
        "ingest_profile": ingest_profile(),
        "schema_report": schema_report(),
        "radius_join": radius_join(),
        "polygon_join": polygon_join(),
        "radius_join_mixed": radius_join_mixed(),
        "radius_join_hot_cell": radius_join_hot_cell(),
        "polygon_join_mixed": polygon_join(P.POLYGONS_MIXED),
        "geocode_lookup": geocode_lookup(),
        "geocode_free_text": geocode_free_text(),
        "circle_outline": circle_outline(),
    }
