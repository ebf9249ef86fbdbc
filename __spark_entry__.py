"""

``entry(spark)`` runs the flagship query (KPIs) on sf0.001; ``queries()``
``(spark, sf_dir)``; ``oracle_sql()`` holds the DuckDB twin of each query.
All queries read the driver's tables through the ``incidents`` fixture view,
so their work grows with the input. The ``*_from_summary`` queries answer the
same questions from the daily summary table (written once per application
from the same view) and share their oracle with the row-level query.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

import oracles  # noqa: E402
import query_params as P  # noqa: E402
from incident_analytics import Circle, IncidentFilter, fixtures, loader, sources, streaming  # noqa: E402
from incident_analytics.functions import dates, geo  # noqa: E402
from incident_analytics.functions.numeric import exact_mean  # noqa: E402
from incident_analytics.operators import (  # noqa: E402
    breakdown, clean, details, geocode, kpi, mapping, options, pyramid, spatial_join, summary, trends)
from incident_analytics.session import scratch_path  # noqa: E402
from incident_analytics.sources import batches  # noqa: E402

try:  # the training-data subpackage and the pipeline over it are optional
    from incident_analytics.llm import registry as llm_registry
    import corpus_pipeline
except ImportError:  # absent, or a package that only it needs is absent
    llm_registry = corpus_pipeline = None

SMOKE_DIR = "/root/testdata/sf0.001"


def _app_key(spark, sf_dir):
    """Key of the per-application, per-scale memos below."""
    try:
        app = spark.sparkContext.applicationId
    except Exception:  # remote (Connect) sessions have no local context
        app = str(id(spark))
    return (app, sf_dir)


_BASE: dict[tuple[str, str], DataFrame] = {}


def _incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incidents view, built once per application and scale and reused,
    as an application holds its base DataFrame: only the plan is kept; every
    query still reads and joins the tables in full."""
    key = _app_key(spark, sf_dir)
    if key not in _BASE:
        _BASE[key] = fixtures.incidents(spark, sf_dir)
    return _BASE[key]


def q_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.kpis(_incidents(spark, sf_dir), *P.KPI_RANGE)


def q_profile(spark, sf_dir):
    return kpi.profile(_incidents(spark, sf_dir))


def q_selection_summary(spark, sf_dir):
    return kpi.selection_summary(_incidents(spark, sf_dir), *P.KPI_RANGE)


def q_category_options(spark, sf_dir):
    return options.category_options(_incidents(spark, sf_dir))


def q_area_options(spark, sf_dir):
    return options.area_options(_incidents(spark, sf_dir))


def q_category_counts(spark, sf_dir):
    return kpi.category_counts(_incidents(spark, sf_dir), *P.KPI_RANGE)


def _trend(metric, order, rng, as_of):
    def run(spark, sf_dir):
        return trends.area_trends(_incidents(spark, sf_dir), rng[0], rng[1],
                                  metric=metric, order=order, as_of=as_of)
    return run


def q_trend_hazard_extreme(spark, sf_dir):
    """Mean hazard of every area with scores from 1e-300 to 1e300, NaN and infinities planted."""
    rows = fixtures.extreme_hazards(_incidents(spark, sf_dir))
    return trends.area_trends(rows, *P.FULL_RANGE, metric="hazard", n=30, as_of=P.AS_OF_AFTER)


def q_category_breakdown(spark, sf_dir):
    return breakdown.category_breakdown(_incidents(spark, sf_dir), *P.KPI_RANGE)


def q_category_rollup(spark, sf_dir):
    return breakdown.category_rollup(_incidents(spark, sf_dir), *P.KPI_RANGE)


def q_subcategory_drilldown(spark, sf_dir):
    return breakdown.subcategory_breakdown(_incidents(spark, sf_dir), "PERSON", *P.KPI_RANGE)


ROW_COLS = ["incident_id", "date", "hour", "crime_against_category", "area", "latitude", "longitude"]


def _filtered(**kw):
    def run(spark, sf_dir):
        flt = IncidentFilter(*P.FULL_RANGE, **kw)
        return flt.apply(_incidents(spark, sf_dir)).select(*ROW_COLS)
    return run


def q_circle_filter(spark, sf_dir):
    lat, lon = P.CENTER
    flt = IncidentFilter(*P.FULL_RANGE, circle=Circle(lat, lon, P.RADIUS_DEFAULT_M))
    dist = F.round(geo.haversine_m(lat, lon, "latitude", "longitude"), 3)
    return flt.apply(_incidents(spark, sf_dir)).select(*ROW_COLS, dist.alias("distance_m"))


DETAIL_FILTER = IncidentFilter(*P.FULL_RANGE, hours=P.DAY_HOURS, categories=P.ALL_CATEGORIES,
                               circle=Circle(*P.CENTER, P.RADIUS_WIDE_M))
MAP_FILTER = IncidentFilter(*P.FULL_RANGE, hours=(0, 24), categories=P.ALL_CATEGORIES)


def q_incident_details(spark, sf_dir):
    return details.incident_details(_incidents(spark, sf_dir), DETAIL_FILTER)


def q_details_page(spark, sf_dir):
    table = details.incident_details(_incidents(spark, sf_dir), DETAIL_FILTER)
    return details.details_page(table, page=P.PAGE_NUMBER, sort_by="hazard_score", ascending=False,
                                where=details.table_filter([("area", "contains", P.PAGE_AREA_TEXT)]))


def q_details_keyset_page(spark, sf_dir):
    """The second page of the sorted and filtered table, from the first one's last row."""
    table = details.incident_details(_incidents(spark, sf_dir), DETAIL_FILTER)
    asked = dict(sort_by="hazard_score", ascending=False, where=details.table_filter([("area", "contains", P.PAGE_AREA_TEXT)]))
    rows = details.page_after(table, None, **asked).collect()  # one page
    return details.page_after(table, rows[-1] if rows else None, **asked)


def q_map_points(spark, sf_dir):
    return mapping.map_points(_incidents(spark, sf_dir), MAP_FILTER)


def q_details_hot_day(spark, sf_dir):
    """The latest 300 incidents where all are on one day."""
    return details.incident_details(fixtures.hot_day(_incidents(spark, sf_dir)), IncidentFilter(), P.HOT_DAY_ROWS)


def q_map_points_hot_day(spark, sf_dir):
    """The 300 map points of least id where all incidents are on one day."""
    return mapping.map_points(fixtures.hot_day(_incidents(spark, sf_dir)), IncidentFilter(), P.HOT_DAY_ROWS)


def q_map_stats(spark, sf_dir):
    return mapping.map_stats(_incidents(spark, sf_dir), MAP_FILTER)


def q_clean_incidents(spark, sf_dir):
    return clean.clean(fixtures.raw_incidents(spark, sf_dir, _incidents(spark, sf_dir)))


def q_clean_audit(spark, sf_dir):
    return clean.clean_audit(fixtures.raw_incidents(spark, sf_dir, _incidents(spark, sf_dir)))


_STAGED: dict[tuple[str, str], str] = {}
_LOADED: dict[tuple[str, str], str] = {}


def _staged_csv(spark, sf_dir):
    """The raw export staged once per application and scale as CSV
    files in the shared folder, one per partition (the landing folder of an export)."""
    key = _app_key(spark, sf_dir)
    if key not in _STAGED:
        _STAGED[key] = sources.write_raw_csv(fixtures.raw_incidents(spark, sf_dir, _incidents(spark, sf_dir)),
                                             scratch_path(spark, "landing"))
    return _STAGED[key]


def _load(spark, sf_dir):
    """Load the staged export into a fresh gold table (the timed load)."""
    gold_path = scratch_path(spark, "gold")
    loader.load_export(spark, _staged_csv(spark, sf_dir), gold_path)
    _LOADED[_app_key(spark, sf_dir)] = gold_path
    return gold_path


def _loaded(spark, sf_dir):
    """The gold table of the last load, loading first if there is none (the
    post-load checks run against what was loaded)."""
    return _LOADED.get(_app_key(spark, sf_dir)) or _load(spark, sf_dir)


def q_ingest_roundtrip(spark, sf_dir):
    return sources.read_gold(spark, _load(spark, sf_dir))


def q_ingest_profile(spark, sf_dir):
    return sources.load_profile(sources.read_gold(spark, _loaded(spark, sf_dir)))


def q_schema_report(spark, sf_dir):
    return sources.schema_report(sources.stored_rows(spark, _loaded(spark, sf_dir)).drop("batch"))


def q_ingest_stream(spark, sf_dir):
    """Ingest the staged export with an available-now stream in
    batches of two files, read the result back."""
    gold_path = scratch_path(spark, "gold-stream")
    q = streaming.start_ingest(spark, _staged_csv(spark, sf_dir), gold_path,
                               scratch_path(spark, "stream-ckpt"), files_per_batch=2)
    q.awaitTermination()
    return sources.read_gold(spark, gold_path)


def q_ingest_append_replay(spark, sf_dir):
    """Load one half of the export, append the other: a first run leaves its
    rows unpublished as a killed load does, the second completes, a third
    replays it. Read back the table."""
    raw = fixtures.raw_incidents(spark, sf_dir, _incidents(spark, sf_dir))
    gold_path, half = scratch_path(spark, "gold-replay"), F.pmod("incident_id", F.lit(2)) == 0
    first, second = (sources.write_raw_csv(raw.where(part), scratch_path(spark, "landing")) for part in (half, ~half))
    loader.load_export(spark, first, gold_path, summary=True)
    killed = batches.folder_of(spark, gold_path, batches.export_id(spark, second))
    sources.write_gold(clean.clean(sources.read_raw_csv(spark, second)), f"{gold_path}/{killed}")
    for _ in range(2):
        loader.load_export(spark, second, gold_path, mode="append")
    return sources.read_gold(spark, gold_path)


def q_summary_append_replay(spark, sf_dir):
    """The daily summary of a table filled by a load and a replayed stream, as KPIs."""
    raw = fixtures.raw_incidents(spark, sf_dir, _incidents(spark, sf_dir))
    gold_path, half = scratch_path(spark, "gold-replay"), F.pmod("incident_id", F.lit(2)) == 0
    first, second = (sources.write_raw_csv(raw.where(part), scratch_path(spark, "landing")) for part in (half, ~half))
    loader.load_export(spark, first, gold_path, summary=True)
    checkpoint = scratch_path(spark, "stream-ckpt")
    for _ in range(2):
        streaming.start_ingest(spark, second, gold_path, checkpoint, summary=True).awaitTermination()
    return kpi.kpis(summary.read_summary(spark, gold_path), *P.KPI_RANGE)


def _audited_load(spark, sf_dir):
    """The staged export loaded with its audit into a fresh gold table."""
    gold_path = scratch_path(spark, "gold-audit")
    loader.load_export(spark, _staged_csv(spark, sf_dir), gold_path, audit=True)
    return gold_path


def q_load_audit(spark, sf_dir):
    """The cleaning's counts, gathered by the load's one scan of the export."""
    return loader.read_audit(spark, _audited_load(spark, sf_dir))


def q_load_rejects(spark, sf_dir):
    """The rows that the load rejected, with the rules that they fail."""
    rows = loader.read_rejects(spark, _audited_load(spark, sf_dir))
    return rows.select(F.col("raw")["incident_id"].cast("bigint").alias("incident_id"), F.array_join("failed", ",").alias("failed"),
                       F.col("raw")["Offense Category"].alias("offense_text"))


def q_curve_layout_filter(spark, sf_dir):
    """Incidents in a circle and in a polygon, from a gold table laid out along the curve."""
    gold_path = scratch_path(spark, "gold-curve")
    sources.write_gold(_incidents(spark, sf_dir), gold_path, layout="curve")
    gold = sources.read_gold(spark, gold_path)
    circle = IncidentFilter(*P.FULL_RANGE, circle=Circle(*P.CENTER, P.RADIUS_DEFAULT_M)).apply(gold)
    ring = IncidentFilter(*P.FULL_RANGE, polygon=P.POLYGON_U).apply(gold)
    return (circle.select(F.lit("circle").alias("shape"), *ROW_COLS)
            .unionByName(ring.select(F.lit("polygon").alias("shape"), *ROW_COLS)))


def _radius_join(spark, sf_dir, radius, incidents=None, split=False):
    """Incidents within the radius of every block centroid, by category."""
    pts = IncidentFilter(*P.FULL_RANGE).apply(incidents or _incidents(spark, sf_dir))
    centers = (pts.where(F.col("location").isNotNull()).groupBy("location")
               .agg(exact_mean(F.col("latitude")).alias("center_lat"),
                    exact_mean(F.col("longitude")).alias("center_lon"))
               .select(F.col("location").alias("center_id"), "center_lat", "center_lon",
                       radius.alias("radius_m")))
    pairs = spatial_join.radius_join(pts.select("incident_id", "crime_against_category",
                                                "latitude", "longitude"), centers, split=split)
    cat = F.col("crime_against_category")
    return pairs.groupBy("center_id").agg(
        F.count(F.lit(1)).alias("incidents"),
        F.count_if(cat == "PERSON").alias("person"),
        F.count_if(cat == "PROPERTY").alias("property"),
        F.count_if(cat == "SOCIETY").alias("society"))


def q_radius_join(spark, sf_dir):
    return _radius_join(spark, sf_dir, F.lit(P.BLOCK_RADIUS_M))


def q_radius_join_mixed(spark, sf_dir):
    """Radii of 161 m to 30 km, by the block's number."""
    block = F.regexp_extract("location", "^([0-9]+)", 1).cast("int") % 3
    small, middle, large = map(F.lit, P.MIXED_RADII_M)
    return _radius_join(spark, sf_dir, F.when(block == 0, small).when(block == 1, middle).otherwise(large))


def q_radius_join_hot_cell(spark, sf_dir):
    """Blocks where a third of all incidents are at one place, whose cell is split."""
    return _radius_join(spark, sf_dir, F.lit(P.BLOCK_RADIUS_M), fixtures.hot_place(_incidents(spark, sf_dir)), split=True)


def _polygon_join(spark, sf_dir, shapes):
    """Incidents inside each of several polygons."""
    pts = IncidentFilter(*P.FULL_RANGE).apply(_incidents(spark, sf_dir))
    polygons = spark.createDataFrame(shapes, "polygon_id INT, geojson STRING")
    pairs = spatial_join.polygon_join(pts.select("incident_id", "latitude", "longitude"), polygons)
    return pairs.groupBy("polygon_id").agg(F.count(F.lit(1)).alias("incidents"))


def q_polygon_join(spark, sf_dir):
    return _polygon_join(spark, sf_dir, P.POLYGONS)


def q_polygon_join_mixed(spark, sf_dir):
    """Boxes of 0.002 to 10 degrees beside the other polygons."""
    return _polygon_join(spark, sf_dir, P.POLYGONS_MIXED)


def _addresses(incidents):
    loc = F.col("location")
    variants = F.array(loc, F.concat(loc, F.lit(", Seattle, WA")), F.concat(loc, F.lit(" annex")))
    return (incidents.where(loc.isNotNull()).select("location").distinct()
            .select(F.explode(variants).alias("address")))


def q_geocode_lookup(spark, sf_dir):
    inc = _incidents(spark, sf_dir)
    return geocode.geocode(_addresses(inc), geocode.gazetteer_from_incidents(inc))


def _typed(incidents):
    """Addresses as people type them: a house number of the block, words turned
    round, a letter left out, changed or moved, another street."""
    loc = F.col("location")
    block, hundred = F.regexp_extract(loc, "^([0-9]+)XX (.*)$", 1), F.lit("07")
    street = F.regexp_replace(F.regexp_extract(loc, "^[0-9]+XX BLOCK OF (.*)$", 1), " ST$", "")
    house = F.concat(block, hundred)
    dropped, moved = F.substring(street, 2, 100), F.concat(F.substring(street, 2, 1), F.substring(street, 1, 1), F.substring(street, 3, 100))
    typed = F.array(F.concat_ws(" ", house, street, F.lit("Street, Seattle WA 98101")), F.concat_ws(" ", street, F.lit("st."), house),
                    F.concat_ws(" ", house, dropped, F.lit("st")), F.concat_ws(" ", house, moved, F.lit("st, apt 4")),
                    F.concat_ws(" ", house, F.concat(F.lit("X"), dropped), F.lit("st")), F.concat_ws(" ", house, F.lit("Elsewhere Ave")))
    return (incidents.where(loc.isNotNull()).select("location").distinct().select(F.explode(typed).alias("address")))


def q_geocode_free_text(spark, sf_dir):
    inc = _incidents(spark, sf_dir)
    return geocode.geocode_text(_typed(inc), geocode.gazetteer_from_incidents(inc))


def q_circle_outline(spark, sf_dir):
    hits = geocode.first_hits(geocode.gazetteer_from_incidents(_incidents(spark, sf_dir)))
    centers = hits.select("key", "display_name", F.lit(P.OUTLINE_RADIUS_M).alias("radius_m"),
                          F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    return geocode.circle_outlines(centers)


def q_subcategory_drilldown_with_empty(spark, sf_dir):
    """SOCIETY has fewer than 20 sub-categories: the rest of the top 20 are the
    date range's other sub-categories with count 0."""
    return breakdown.subcategory_breakdown(_incidents(spark, sf_dir), "SOCIETY", *P.KPI_RANGE,
                                           include_empty=True)


def q_location_frequency(spark, sf_dir):
    return mapping.location_frequency(_incidents(spark, sf_dir), MAP_FILTER)


PYRAMID_FILTER = IncidentFilter(*P.KPI_RANGE, hours=P.DAY_HOURS, categories=P.TWO_CATEGORIES)


def _from_pyramid(view):
    """A map answer from a spatial summary written in two batches and read back."""
    def run(spark, sf_dir):
        inc, path = _incidents(spark, sf_dir), scratch_path(spark, "pyramid")
        half = F.pmod("incident_id", F.lit(2)) == 0
        pyramid.write_spatial_summary(inc.where(half), path)
        pyramid.write_spatial_summary(inc.where(~half), path, mode="append")
        return view(pyramid.read_spatial_summary(spark, path), PYRAMID_FILTER)
    return run


def q_kpis_default_range(spark, sf_dir):
    """KPIs of the dashboard's first screen: the 365 days up to a date."""
    return kpi.kpis(_incidents(spark, sf_dir), *dates.default_range(P.AS_OF_INSIDE))


def q_scan_datetime_bounds(spark, sf_dir):
    """Scan of the loaded table between two datetimes."""
    return sources.read_gold(spark, _load(spark, sf_dir), *P.DATETIME_BOUNDS)


def q_scan_limit(spark, sf_dir):
    """Rows and distinct ids of a scan with a row limit."""
    rows = sources.read_gold(spark, _load(spark, sf_dir), limit=P.SCAN_ROWS)
    return rows.agg(F.count(F.lit(1)).alias("records"), F.count_distinct("incident_id").alias("ids"))


def q_smoke_row(spark, sf_dir):
    """The post-load smoke row: one, of the table, with coordinates."""
    table = sources.gold_table(spark, _load(spark, sf_dir))
    row = sources.smoke(table).select("incident_id", "latitude", "longitude")
    return row.join(table, ["incident_id", "latitude", "longitude"], "left_semi").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
        .alias("with_coords"))


def q_geocoder_reply(spark, sf_dir):
    """First hits of stored geocoder replies: of one or two hits, none, or unreadable."""
    hits = geocode.first_hits(geocode.gazetteer_from_incidents(_incidents(spark, sf_dir)))
    number = F.regexp_extract("key", "^([0-9]+)", 1).cast("int")
    hit = F.struct(F.col("lat").cast("string").alias("lat"), F.col("lon").cast("string").alias("lon"), "display_name")
    other = F.struct(F.lit("0.0").alias("lat"), F.lit("0.0").alias("lon"), F.lit("second").alias("display_name"))
    reply = (F.when(number % 7 == 0, F.lit("[]")).when(number % 11 == 0, F.lit("<html>"))
             .when(number % 2 == 0, F.to_json(F.array(hit, other))).otherwise(F.to_json(F.array(hit))))
    return hits.select("key", geocode.parse_geocoder_reply(reply).alias("hit")).select("key", "hit.*")


_SUMMARIES: dict[tuple[str, str], str] = {}


def _summary(spark, sf_dir):
    """The daily summary of the incidents, written once per application and
    scale to the shared folder (as a deployment maintains it at load time)."""
    key = _app_key(spark, sf_dir)
    if key not in _SUMMARIES:
        _SUMMARIES[key] = summary.write_summary(_incidents(spark, sf_dir), scratch_path(spark, "summary"))
    return summary.read_summary(spark, _SUMMARIES[key])


def _from_summary(view):
    def run(spark, sf_dir):
        return view(_summary(spark, sf_dir))
    return run


SUMMARY_VIEWS = {
    "profile": lambda s: kpi.profile(s),
    "selection_summary": lambda s: kpi.selection_summary(s, *P.KPI_RANGE),
    "kpis": lambda s: kpi.kpis(s, *P.KPI_RANGE),
    "category_counts": lambda s: kpi.category_counts(s, *P.KPI_RANGE),
    "category_options": lambda s: options.category_options(s),
    "trend_count_top": lambda s: trends.area_trends(s, *P.FULL_RANGE, as_of=P.AS_OF_AFTER),
    "trend_hazard_bottom": lambda s: trends.area_trends(s, *P.FULL_RANGE, metric="hazard", order="bottom",
                                                        as_of=P.AS_OF_AFTER),
    "trend_weekly": lambda s: trends.area_trends(s, *P.WEEKLY_RANGE, as_of=P.AS_OF_AFTER),
    "category_breakdown": lambda s: breakdown.category_breakdown(s, *P.KPI_RANGE),
    "category_rollup": lambda s: breakdown.category_rollup(s, *P.KPI_RANGE),
    "subcategory_drilldown": lambda s: breakdown.subcategory_breakdown(s, "PERSON", *P.KPI_RANGE),
}


def entry(spark: SparkSession) -> DataFrame:
    return q_kpis(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "kpis": q_kpis,
        "profile": q_profile,
        "selection_summary": q_selection_summary,
        "category_options": q_category_options,
        "area_options": q_area_options,
        "category_counts": q_category_counts,
        "trend_count_top": _trend("count", "top", P.FULL_RANGE, P.AS_OF_AFTER),
        "trend_count_bottom": _trend("count", "bottom", P.FULL_RANGE, P.AS_OF_AFTER),
        "trend_hazard_top": _trend("hazard", "top", P.FULL_RANGE, P.AS_OF_AFTER),
        "trend_hazard_bottom": _trend("hazard", "bottom", P.FULL_RANGE, P.AS_OF_AFTER),
        "trend_hazard_extreme": q_trend_hazard_extreme,
        "trend_weekly": _trend("count", "top", P.WEEKLY_RANGE, P.AS_OF_AFTER),
        "trend_daily": _trend("hazard", "top", P.DAILY_RANGE, P.AS_OF_AFTER),
        "trend_month_cut": _trend("count", "top", P.FULL_RANGE, P.AS_OF_INSIDE),
        "category_breakdown": q_category_breakdown,
        "category_rollup": q_category_rollup,
        "subcategory_drilldown": q_subcategory_drilldown,
        "subcategory_drilldown_with_empty": q_subcategory_drilldown_with_empty,
        "hour_filter": _filtered(hours=P.NIGHT_HOURS),
        "category_filter": _filtered(categories=P.TWO_CATEGORIES),
        "area_filter": _filtered(areas=P.THREE_AREAS),
        "polygon_filter": _filtered(polygon=P.POLYGON_U),
        "circle_filter": q_circle_filter,
        "incident_details": q_incident_details,
        "details_page": q_details_page,
        "details_keyset_page": q_details_keyset_page,
        "map_points": q_map_points,
        "details_hot_day": q_details_hot_day,
        "map_points_hot_day": q_map_points_hot_day,
        "map_stats": q_map_stats,
        "location_frequency": q_location_frequency,
        "location_frequency_from_pyramid": _from_pyramid(pyramid.location_frequency),
        "map_totals_from_pyramid": _from_pyramid(pyramid.map_totals),
        "density_from_pyramid": _from_pyramid(pyramid.density),
        "kpis_default_range": q_kpis_default_range,
        "scan_datetime_bounds": q_scan_datetime_bounds,
        "scan_limit": q_scan_limit,
        "smoke_row": q_smoke_row,
        "geocoder_reply": q_geocoder_reply,
        "clean_incidents": q_clean_incidents,
        "clean_audit": q_clean_audit,
        "ingest_roundtrip": q_ingest_roundtrip,
        "ingest_stream": q_ingest_stream,
        "ingest_append_replay": q_ingest_append_replay,
        "summary_append_replay": q_summary_append_replay,
        "load_audit": q_load_audit,
        "load_rejects": q_load_rejects,
        "curve_layout_filter": q_curve_layout_filter,
        "ingest_profile": q_ingest_profile,
        "schema_report": q_schema_report,
        "radius_join": q_radius_join,
        "polygon_join": q_polygon_join,
        "radius_join_mixed": q_radius_join_mixed,
        "radius_join_hot_cell": q_radius_join_hot_cell,
        "polygon_join_mixed": q_polygon_join_mixed,
        "geocode_lookup": q_geocode_lookup,
        "geocode_free_text": q_geocode_free_text,
        "circle_outline": q_circle_outline,
        **{f"{name}_from_summary": _from_summary(view) for name, view in SUMMARY_VIEWS.items()},
        **({**llm_registry.QUERIES, "pipeline": corpus_pipeline.run} if llm_registry else {}),
    }


def oracle_sql() -> dict[str, str]:
    sql = oracles.all_sql()
    # the summary-backed views must give the row-level answers exactly
    sql.update({f"{name}_from_summary": sql[name] for name in SUMMARY_VIEWS})
    if llm_registry:
        sql.update(llm_registry.ORACLES)
        if corpus_pipeline.ORACLE_SQL:
            sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {k: v for k, v in sql.items() if k in queries()}
