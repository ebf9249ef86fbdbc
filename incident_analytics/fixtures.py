"""Test views derived from the driver's tables.

``incidents`` is derived by integer arithmetic from
``events ⋈ customer ⋈ nation ⋈ region`` (see FIXTURES.md); ``raw_incidents``
plants cleaning faults into it by residue of ``incident_id``. Both are plain
DataFrame plans, so they scale with the input tables.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIXTURE_EPOCH = dt.date(2022, 1, 1)


# Read schemas of the source tables (the columns the fixture uses). An
# explicit schema skips footer-based inference on every plan and reads only
# these columns.
SOURCE_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_nationkey INT, c_mktsegment STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in SOURCE_SCHEMAS:
        reader = reader.schema(SOURCE_SCHEMAS[name])
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gold incident view over one scale directory."""
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")

    # Dimension chain first (nation and region are tiny; Spark broadcasts them
    # by its own size check), then one shuffle join of events with customers.
    geo = nation.join(region, nation.n_regionkey == region.r_regionkey)
    cust = customer.join(geo, customer.c_nationkey == geo.n_nationkey)
    joined = events.join(cust, events.user_id == cust.c_custkey)

    eid = F.col("event_id")
    day = F.date_add(F.lit(FIXTURE_EPOCH), ((eid * 37) % 730).cast("int"))
    clock = F.date_format("ts", "HH:mm:ss")
    kind = F.upper("event_type")
    k = F.get_json_object("props", "$.k").try_cast("int")
    category = (
        F.when(F.col("event_type").isin("purchase", "view"), "PROPERTY")
        .when(F.col("event_type").isin("error", "click"), "PERSON")
        .otherwise("SOCIETY")
    )
    lat = F.lit(47.4955) + ((eid * 7919) % 61) * F.lit(0.0037) + (eid % 3) * F.lit(1e-05)
    lon = F.lit(-122.435) + ((eid * 104729) % 47) * F.lit(0.0043) + (eid % 3) * F.lit(1e-05)
    null_double = F.lit(None).cast("double")
    return joined.select(
        eid.alias("incident_id"),
        day.alias("date"),
        clock.alias("time"),
        F.hour("ts").cast("int").alias("hour"),
        F.concat(day.cast("string"), F.lit(" "), clock).alias("datetime"),
        kind.alias("offense"),
        F.concat(kind, F.lit("_"), (k % 13).cast("string")).alias("offense_sub_category"),
        category.alias("crime_against_category"),
        F.concat((eid % 97).cast("string"), F.lit("XX BLOCK OF MAIN ST")).alias("location"),
        F.col("n_name").alias("area"),
        F.col("r_name").alias("precinct"),
        F.substring("c_mktsegment", 1, 1).alias("sector"),
        F.when(eid % 50 == 0, null_double).otherwise(F.col("value")).alias("hazardness"),
        F.when(eid % 101 == 0, null_double).otherwise(lat).alias("latitude"),
        F.when(eid % 103 == 0, null_double).otherwise(lon).alias("longitude"),
    )


# Fixed values of this fixture: planted faults per raw column, as
# (residue of incident_id, planted text); the first matching residue wins.
RAW_FAULTS = {
    "Offense Category": [(11, "REDACTED")],
    "Offense Sub Category": [(17, "UNKNOWN"), (19, "999"), (23, ""), (29, None)],
    "NIBRS Crime Against Category": [(31, "ANY"), (37, "NOT_A_CRIME")],
    "Block Address": [(41, None)],
    "Neighborhood": [(43, "UNKNOWN"), (47, "FK ERROR"), (53, "OOJ"), (59, None)],
    "Precinct": [(13, "-")],
    "Sector": [(61, "None"), (67, "99")],
    "Beat": [(71, None)],
    "Reporting Area": [(73, None)],
    "Hazardness": [(109, "-1.0")],
    "Latitude": [(79, "abc"), (83, "0.0"), (89, "49.0")],
    "Longitude": [(97, "-120.0")],
}
# Offense Date faults: null, 30 February, hour 25, no time part, one-digit
# hour, one-digit minute and second.
DATE_FAULTS = [(211, "null"), (223, "feb30"), (227, "hour25"), (229, "no_time"),
               (233, "9:05:00"), (239, "09:5:1")]
SHOOTING_RESIDUE = 7


def _fault(i: Column, cases: list[tuple[int, object]], value: Column) -> Column:
    """``value`` unless ``i`` hits one of the residues; first hit wins."""
    out = None
    for modulus, planted in cases:
        cond = i % modulus == 0
        lit = F.lit(planted).cast("string")
        out = F.when(cond, lit) if out is None else out.when(cond, lit)
    return out.otherwise(value)


def raw_incidents(spark: SparkSession, sf_dir: str, gold: DataFrame | None = None) -> DataFrame:
    """Raw, all-text export rows with planted faults (FIXTURES.md §2,
    ``RAW_FAULTS`` and ``DATE_FAULTS``); shooting type is set on every
    seventh row and missing elsewhere. ``gold`` may pass the incidents view
    already built for ``sf_dir``."""
    gold = incidents(spark, sf_dir) if gold is None else gold
    i = F.col("incident_id")
    day_text = F.col("date").cast("string")
    planted = {
        "null": F.lit(None).cast("string"),
        "feb30": F.concat(F.year("date").cast("string"), F.lit("-02-30 "), F.col("time")),
        "hour25": F.concat(day_text, F.lit(" 25:00:00")),
        "no_time": day_text,
        "9:05:00": F.concat(day_text, F.lit(" 9:05:00")),
        "09:5:1": F.concat(day_text, F.lit(" 09:5:1")),
    }
    offense_date = None
    for modulus, kind in DATE_FAULTS:
        cond = i % modulus == 0
        offense_date = (F.when(cond, planted[kind]) if offense_date is None
                        else offense_date.when(cond, planted[kind]))
    offense_date = offense_date.otherwise(F.concat(day_text, F.lit(" "), F.col("time")))
    source = {
        "Offense Category": F.col("offense"),
        "Offense Sub Category": F.col("offense_sub_category"),
        "NIBRS Crime Against Category": F.col("crime_against_category"),
        "Block Address": F.col("location"),
        "Neighborhood": F.col("area"),
        "Precinct": F.col("precinct"),
        "Sector": F.col("sector"),
        "Beat": F.concat(F.col("sector"), ((i % 3) + 1).cast("string")),
        "Reporting Area": (i % 900).cast("string"),
        "Hazardness": F.col("hazardness").cast("string"),
        "Latitude": F.col("latitude").cast("string"),
        "Longitude": F.col("longitude").cast("string"),
    }
    shooting = F.when(i % SHOOTING_RESIDUE == 0, F.lit("Non-Fatal"))
    cols = {name: _fault(i, RAW_FAULTS[name], expr) for name, expr in source.items()}
    cols["Offense Date"] = offense_date
    cols["Shooting Type Group"] = shooting
    from .schema import RAW_COLUMNS
    return gold.select(i.alias("incident_id"), *[cols[c].alias(c) for c in RAW_COLUMNS])


def extreme_hazards(gold: DataFrame) -> DataFrame:
    """The incidents view with scores of every size planted by residue of
    ``incident_id``: 1e10 and 1e300 more, 1e-300 times, NaN, both infinities."""
    i, h = F.col("incident_id"), F.col("hazardness")
    return gold.withColumn("hazardness", (
        F.when(i % 397 == 0, F.lit(float("inf"))).when(i % 401 == 0, F.lit(float("-inf")))
        .when(i % 13 == 0, F.lit(float("nan"))).when(i % 11 == 0, h + F.lit(1e10))
        .when(i % 7 == 0, h * F.lit(1e-300)).when((i % 5 == 0) & (i % 3 == 0), F.lit(1e300)).otherwise(h)))


HOT_DAY = dt.date(2023, 6, 1)


def hot_day(gold: DataFrame) -> DataFrame:
    """The incidents view with every row's date moved to one day, its time kept."""
    day = F.lit(HOT_DAY)
    return (gold.withColumn("date", day)
            .withColumn("datetime", F.concat(day.cast("string"), F.lit(" "), F.col("time"))))


HOT_PLACE = (47.6062, -122.3321)


def hot_place(gold: DataFrame) -> DataFrame:
    """The incidents view with every third row's coordinates (where it has them) moved to one place."""
    moved = (F.pmod("incident_id", F.lit(3)) == 0) & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    lat, lon = HOT_PLACE
    return (gold.withColumn("latitude", F.when(moved, F.lit(lat)).otherwise(F.col("latitude")))
            .withColumn("longitude", F.when(moved, F.lit(lon)).otherwise(F.col("longitude"))))
