"""Cleaning on random raw rows against a plain-Python implementation of the rules."""

from __future__ import annotations

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from incident_analytics.operators import clean
from incident_analytics.schema import RAW_COLUMNS, RAW_INCIDENTS

PLACEHOLDERS = {"-", "REDACTED", "-1.0"}
# time text → hour (None: unparseable, hour 0)
TIMES = {"09:15:00": 9, "9:05:00": 9, "09:5:1": 9, "23:59:59": 23, "00:00:00": 0,
         "25:00:00": None, "12:60:00": None, "ab:cd:ef": None}
DATES = ["2023-03-05", "2022-02-28", "2024-02-29", "2023-02-29", "2023-02-30", "2023-13-01", "20x3-01-01"]
POOLS = {
    "Offense Category": ["THEFT", "ASSAULT", "REDACTED", None],
    "Offense Sub Category": ["LARCENY", "ROBBERY", "UNKNOWN", "999", "", None, "-"],
    "NIBRS Crime Against Category": ["PERSON", "PROPERTY", "SOCIETY", "ANY", "NOT_A_CRIME", None],
    "Block Address": ["1XX BLOCK OF PINE ST", None, "-"],
    "Neighborhood": ["DOWNTOWN", "BALLARD", "UNKNOWN", "FK ERROR", "OOJ", None],
    "Precinct": ["WEST", "-", None],
    "Sector": ["K", "None", "99", None],
    "Beat": ["K1", None],
    "Reporting Area": ["101", None, "REDACTED"],
    "Shooting Type Group": ["Non-Fatal", None],
    "Hazardness": ["3.5", "-1.0", "x", None, "12"],
    "Latitude": ["47.61", "47.0", "48.1", "48.2", "0.0", "abc", None, "-1.0"],
    "Longitude": ["-122.33", "-123.5", "-121.0", "-120.0", "abc", None],
}


def brute(row: dict) -> dict | None:
    r = {k: (None if (v in PLACEHOLDERS) else v) for k, v in row.items()}

    def num(x):
        try:
            return float(x)
        except (TypeError, ValueError):
            return None
    lat, lon = num(r["Latitude"]), num(r["Longitude"])
    if lat is None or lon is None or not (47.0 <= lat <= 48.1 and -123.5 <= lon <= -121.0):
        return None
    if r["Neighborhood"] in (None, "UNKNOWN", "FK ERROR", "OOJ"):
        return None
    if r["NIBRS Crime Against Category"] not in ("PERSON", "PROPERTY", "SOCIETY"):
        return None
    if r["Offense Sub Category"] in (None, "UNKNOWN", "999", ""):
        return None
    if any(r[c] is None for c in ("Block Address", "Reporting Area", "Beat")):
        return None
    if r["Sector"] in (None, "None", "99"):
        return None
    od = r["Offense Date"]
    day_text, _, time_text = (od.partition(" ") if od else (None, "", ""))
    time = time_text or None
    try:
        y, m, d = (int(p) for p in day_text.split("-"))
        date = dt.date(y, m, d)
    except (AttributeError, ValueError):
        date = None
    hour = TIMES.get(time) if time else None
    return {
        "incident_id": row["incident_id"], "date": date, "time": time, "hour": hour or 0,
        "datetime": f"{date} {time}" if date and time else None,
        "offense": r["Offense Category"], "offense_sub_category": r["Offense Sub Category"],
        "crime_against_category": r["NIBRS Crime Against Category"], "location": r["Block Address"],
        "area": r["Neighborhood"], "precinct": r["Precinct"], "sector": r["Sector"],
        "hazardness": num(r["Hazardness"]), "latitude": lat, "longitude": lon,
    }


def weighted(values: list) -> list:
    """The first value of each pool is valid; weight it so most rows survive
    most rules (a row passes all nine rules about a quarter of the time)."""
    return [values[0]] * (6 * len(values)) + values


def raw_rows(draw_count):
    offense_date = st.one_of(st.none(), st.builds(lambda d, t: f"{d} {t}" if t else d,
                                                    st.sampled_from(DATES), st.sampled_from([None, *TIMES])))
    row = st.fixed_dictionaries({"Offense Date": offense_date,
                                 **{c: st.sampled_from(weighted(v)) for c, v in POOLS.items()}})
    return st.lists(row, min_size=1, max_size=draw_count)


def check(spark, rows) -> int:
    for i, r in enumerate(rows):
        r["incident_id"] = i
    df = spark.createDataFrame([tuple([r["incident_id"]] + [r[c] for c in RAW_COLUMNS]) for r in rows],
                               RAW_INCIDENTS)
    got = {r["incident_id"]: r.asDict() for r in clean.clean(df).collect()}
    want = {b["incident_id"]: b for b in map(brute, rows) if b is not None}
    assert got == want
    return len(want)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=raw_rows(60))
def test_clean_matches_brute_force(spark, rows):
    check(spark, rows)


def test_clean_matches_brute_force_bulk(spark):
    import random
    rnd = random.Random(11)
    rows = []
    for _ in range(2000):
        od = None if rnd.random() < 0.05 else (
            rnd.choice(DATES) + ("" if rnd.random() < 0.1 else " " + rnd.choice(list(TIMES))))
        rows.append({"Offense Date": od, **{c: rnd.choice(weighted(v)) for c, v in POOLS.items()}})
    kept = check(spark, rows)
    assert 200 < kept < 1800   # both outcomes are well exercised
