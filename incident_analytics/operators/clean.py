"""Cleaning: raw export rows → gold incident rows (C1–C13, P1–P4) and an audit (C14).

Everything is a per-row expression, so cleaning is one narrow stage (no
shuffle) and runs at scan speed on any number of executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.dates import date_from_parts, hour_of
from ..schema import CORRUPT, DATE_PARTS, GOLD_COLUMNS, RAW_TO_GOLD

# Fixed values of the cleaning rules.
PLACEHOLDERS = ("-", "REDACTED", "-1.0")
LAT_RANGE = (47.0, 48.1)
LON_RANGE = (-123.5, -121.0)
BAD_AREAS = ("UNKNOWN", "FK ERROR", "OOJ")
VALID_CATEGORIES = ("PERSON", "PROPERTY", "SOCIETY")
BAD_SUBCATEGORIES = ("UNKNOWN", "999", "")
REQUIRED = ("Latitude", "Longitude", "Block Address", "Reporting Area", "Beat")
BAD_SECTORS = ("None", "99")
NO_SHOOTING = "No Shooting"


def standardize_missing(raw: DataFrame) -> DataFrame:
    """Placeholder tokens → null in every text column (one projection)."""
    cols = []
    for field in raw.schema.fields:
        c = F.col(f"`{field.name}`")
        if field.dataType.simpleString() == "string":
            c = F.when(~c.isin(*PLACEHOLDERS), c)
        cols.append(c.alias(field.name))
    return raw.select(*cols)


def with_numeric_coords(df: DataFrame) -> DataFrame:
    """Coordinates to DOUBLE; text that is not a number → null."""
    return (df.withColumn("Latitude", F.col("Latitude").try_cast("double"))
              .withColumn("Longitude", F.col("Longitude").try_cast("double")))


def keep_rules(c=F.col, columns: list[str] | None = None) -> dict[str, Column]:
    """One keep-condition per rule, over the C1/C2 output. ``columns``:
    those of the export; C7 asks for values of the required ones it has."""
    required = [name for name in REQUIRED if columns is None or name in columns]
    area, sub = c("Neighborhood"), c("Offense Sub Category")
    return {
        "c3_coordinate_range": (c("Latitude").between(*LAT_RANGE) & c("Longitude").between(*LON_RANGE)),
        "c4_neighborhood": area.isNotNull() & ~area.isin(*BAD_AREAS),
        "c5_category": c("NIBRS Crime Against Category").isin(*VALID_CATEGORIES),
        "c6_sub_category": sub.isNotNull() & ~sub.isin(*BAD_SUBCATEGORIES),
        "c7_required": _all_not_null([c(name) for name in required]),
        "c8_sector": c("Sector").isNotNull() & ~c("Sector").isin(*BAD_SECTORS),
    }


def _all_not_null(cols: list[Column]) -> Column:
    out = cols[0].isNotNull()
    for col in cols[1:]:
        out = out & col.isNotNull()
    return out


def _date_parts(columns: list[str]) -> dict[str, Column]:
    """Split ``yyyy-MM-dd HH:mm:ss`` text into year, month, day, time; an
    export without that text has the parts in columns of their own."""
    if "Offense Date" not in columns:
        *numbers, time = DATE_PARTS
        parts = {n.split()[-1].lower(): F.col(f"`{n}`").try_cast("double").try_cast("int") for n in numbers}
        return parts | {"time": F.nullif(F.col(f"`{time}`"), F.lit(""))}
    halves = F.split(F.col("Offense Date"), " ")
    day_part = F.split(F.try_element_at(halves, F.lit(1)), "-")
    return {
        "year": F.try_element_at(day_part, F.lit(1)).try_cast("int"),
        "month": F.try_element_at(day_part, F.lit(2)).try_cast("int"),
        "day": F.try_element_at(day_part, F.lit(3)).try_cast("int"),
        "time": F.nullif(F.try_element_at(halves, F.lit(2)), F.lit("")),
    }


def _gold_columns(columns: list[str]) -> list[Column]:
    """Gold columns over the C1/C2 output of an export with these columns."""
    parts = _date_parts(columns)                                     # C10
    date = date_from_parts(parts["year"], parts["month"], parts["day"])  # P1
    time = parts["time"]                                             # P2
    return [
        *([F.col("incident_id")] if "incident_id" in columns else []),
        date.alias("date"),
        time.alias("time"),
        hour_of(time).alias("hour"),                                 # P3
        F.concat(date.cast("string"), F.lit(" "), time).alias("datetime"),  # P4
        # C12 select and rename (C11: hazard text to DOUBLE; C2 did the coordinates)
        *[(F.col(f"`{raw}`").try_cast("double") if gold == "hazardness" else F.col(f"`{raw}`")).alias(gold)
          for raw, gold in RAW_TO_GOLD.items()],
    ]


def clean(raw: DataFrame) -> DataFrame:
    """Raw export → gold rows: ``incident_id`` (when present) + the 14 gold columns."""
    s = with_numeric_coords(standardize_missing(raw))
    s = s.where(_all(keep_rules(columns=raw.columns)))
    if "Shooting Type Group" in raw.columns:
        s = s.fillna({"Shooting Type Group": NO_SHOOTING})           # C9
    out = s.select(*_gold_columns(raw.columns))
    assert out.columns[-len(GOLD_COLUMNS):] == GOLD_COLUMNS
    return out


def _all(rules: dict[str, Column]) -> Column:
    keep = None
    for cond in rules.values():
        keep = cond if keep is None else keep & cond
    return keep


def _audited(raw: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """The C1/C2 output with what the audit needs besides, and its metrics (C14)."""
    text_cols = [f.name for f in raw.schema.fields
                 if f.dataType.simpleString() == "string" and f.name != CORRUPT]
    placeholder = None
    for name in text_cols:
        hit = F.coalesce(F.col(f"`{name}`").isin(*PLACEHOLDERS), F.lit(False))
        placeholder = hit if placeholder is None else placeholder | hit
    flagged = raw.withColumn("_placeholder", placeholder)
    s = standardize_missing(flagged)
    s = (s.withColumn("_lat_text", F.col("Latitude"))
          .withColumn("_lon_text", F.col("Longitude")))
    s = with_numeric_coords(s)
    unparseable = ((F.col("_lat_text").isNotNull() & F.col("Latitude").isNull())
                   | (F.col("_lon_text").isNotNull() & F.col("Longitude").isNull()))
    rules = keep_rules(columns=raw.columns)
    parts = _date_parts(raw.columns)
    date = date_from_parts(parts["year"], parts["month"], parts["day"])
    hour_missing = F.hour(F.try_to_timestamp(parts["time"], F.lit("H:m:s"))).isNull()
    metrics = {
        "rows_in": F.count(F.lit(1)),
        "c1_placeholder_rows": F.count_if(F.col("_placeholder")),
        "c2_unparseable_coordinates": F.count_if(unparseable),
        **{name: F.count_if(~F.coalesce(cond, F.lit(False))) for name, cond in rules.items()},
        "c9_shooting_filled": (F.count_if(F.col("Shooting Type Group").isNull())
                               if "Shooting Type Group" in raw.columns else F.lit(0).cast("bigint")),
        "p1_bad_date": F.count_if(date.isNull()),
        "p3_hour_defaulted": F.count_if(hour_missing),
        "rows_out": F.count_if(F.coalesce(_all(rules), F.lit(False))),
    }
    if CORRUPT in raw.columns:
        metrics["unreadable_rows"] = F.count_if(F.col(CORRUPT).isNotNull())
    return s, metrics


def clean_audit(raw: DataFrame) -> DataFrame:
    """C14: rows in, rows failing each rule (each rule on its own), rows out,
    in one aggregate pass; returned long as (rule, rows). Rows of an export
    that did not fit its header are counted as ``unreadable_rows``."""
    s, metrics = _audited(raw)
    wide = s.agg(*[expr.alias(name) for name, expr in metrics.items()])
    return wide.unpivot([], list(metrics), "rule", "rows")


def clean_observed(raw: DataFrame, observation: Observation) -> DataFrame:
    """Every raw row cleaned but none removed: the gold columns (null where the
    row fails), ``failed`` (names of the rules that it fails), ``raw`` (a map of
    the export's columns as read, null where the row is kept) and ``rejected``. The
    audit's counts (C14) are gathered by ``observation`` while the rows are
    written; they count each row once if the write follows without a shuffle."""
    entries = [x for c in raw.columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    whole = raw.withColumn("_raw", F.create_map(*entries))
    s, metrics = _audited(whole)
    s = s.observe(observation, *[expr.alias(name) for name, expr in metrics.items()])
    names = [F.when(~F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in keep_rules(columns=raw.columns).items()]
    failed = F.array_compact(F.array(*names))
    gold = s.select(*_gold_columns(raw.columns), failed.alias("failed"), "_raw")
    kept = [c for c in gold.columns if c not in ("failed", "_raw")]
    rejected = F.size("failed") > 0
    return gold.select(*[F.when(~rejected, F.col(c)).alias(c) for c in kept], "failed",
                       F.when(rejected, F.col("_raw")).alias("raw"), rejected.alias("rejected"))
