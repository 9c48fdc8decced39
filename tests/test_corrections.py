"""Ties, nulls, windows past midnight, rare weekdays, holes, parts and ordinals in street names."""

from __future__ import annotations

import collections
import datetime as dt

import pytest
from pyspark.sql import functions as F

from curbspark.functions import schedule
from curbspark.operators import accounts
from curbspark.operators.upsert import insert_if_absent
from curbspark.plans import normalize, rules


def test_exactly_one_row_of_a_key_is_inserted(spark):
    schema = "email string, seq int, note string"
    target = spark.createDataFrame([("old", 1, "t")], schema)
    rows = [("a", 1, "x"), ("a", 1, "y"), ("b", None, "p"), ("b", None, "p"), ("c", None, "q"), ("c", 5, "r"), ("old", 0, "z"), ("old", 0, "z")]
    inserted, already = insert_if_absent(target, spark.createDataFrame(rows, schema), ["email"], ["seq"])
    got = [tuple(r) for r in inserted.collect()]
    assert sorted(got, key=str) == [("a", 1, "x"), ("b", None, "p"), ("c", 5, "r")]
    rest = collections.Counter(tuple(r) for r in already.collect())
    assert rest + collections.Counter(got) == collections.Counter(rows)


def test_every_user_gets_one_profile(spark):
    at = dt.datetime(2024, 1, 1)
    users = spark.createDataFrame(
        [("u1", "{}", "a", at), ("u1", "{}", "b", at), ("u2", "{}", "c", None)],
        "id string, raw_user_meta_data string, email string, created_at timestamp",
    )
    profiles = spark.createDataFrame([], "id string, full_name string, email string, created_at timestamp")
    assert sorted(r.id for r in accounts.add_profiles(profiles, users).collect()) == ["u1", "u2"]


@pytest.mark.parametrize(
    ("at", "start", "end", "weeks", "holds"),
    [
        ("2024-01-01 23:00:00", "22:00", "02:00", None, True),  # a Monday
        ("2024-01-02 01:59:59", "22:00", "02:00", None, True),
        ("2024-01-02 02:00:00", "22:00", "02:00", None, False),
        ("2024-01-02 23:00:00", "22:00", "02:00", None, False),
        ("2024-01-01 10:00:00", "9:00", "11:00", None, True),
        ("2024-01-01 08:00:00", "08:00:00", "10:00:00", None, True),
        ("2024-01-01 10:00:00", "08:00:00", "10:00:00", None, False),
        ("2024-01-01 10:00:00", "08:00", "10:00:30", "1,3", True),
        ("2024-01-08 09:00:00", "08:00", "10:00", "1,3", False),
        ("2024-01-30 01:00:00", "22:00", "02:00", "5", True),
        ("2024-01-01 23:59:59", "20:00", "24:00", None, True),
        ("2024-01-01 09:00:00", "soon", "10:00", None, None),
    ],
)
def test_windows(spark, at, start, end, weeks, holds):
    row = spark.createDataFrame([(at, start, end, weeks)], "at string, s string, e string, w string")
    local = F.col("at").cast("timestamp_ntz")
    got = row.select(schedule.in_force(local, F.lit("Monday"), F.col("s"), F.col("e"), F.col("w"))).first()[0]
    assert got == holds or (holds is None and not got)


def test_next_start_of_a_fifth_weekday(spark):
    """From every day of eight years, against a plain search."""
    first = dt.date(2020, 1, 1)
    days = spark.range(0, 8 * 365, 5).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("d"))
    got = days.select(
        "d", schedule.next_start(F.col("d").cast("timestamp_ntz"), F.lit("Mon"), F.lit("9:30"), F.lit("5")).alias("n")
    ).collect()
    for r in got:
        day = r.d
        while day.weekday() != 0 or (day.day - 1) // 7 != 4:
            day += dt.timedelta(1)
        assert r.n == dt.datetime(day.year, day.month, day.day, 9, 30)
    gap = spark.range(1).select(
        schedule.next_start(F.lit("2026-12-08 00:00:00").cast("timestamp_ntz"), F.lit("Mon"), F.lit("08:00"), F.lit("5"))
    )
    assert gap.first()[0] == dt.datetime(2027, 3, 29, 8)


def test_zones_with_holes_and_parts(spark):
    square = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]
    shapes = [
        ("hole", f'{{"type":"Polygon","coordinates":[{square(0.0, 0.1)},{square(0.04, 0.06)}]}}'),
        ("parts", f'{{"type":"MultiPolygon","coordinates":[[{square(0.0, 0.02)}],[{square(0.2, 0.3)},{square(0.24, 0.26)}]]}}'),
        ("none", None),
    ]
    zones = spark.createDataFrame([(k, g, True) for k, g in shapes], "id string, boundary_geojson string, is_active boolean")
    points = {"in_hole": 0.05, "corner": 0.01, "ring": 0.03, "second": 0.21, "second_hole": 0.25, "out": 0.5}
    spots = spark.createDataFrame([(k, v, v) for k, v in points.items()], "id string, latitude double, longitude double")
    got = {(r.spot_id, r.zone_id) for r in rules.zones_of_points(spots, rules.with_rings(zones)).collect()}
    assert got == {("corner", "hole"), ("corner", "parts"), ("ring", "hole"), ("second", "parts")}


def test_ordinal_streets_keep_their_names(spark):
    lines = ["3RD ST, San Francisco, CA", "12 24TH ST, San Francisco, CA", "24th St, X", "1200-1210 Main St, X", "Main St, X"]
    rows = [(str(k), a, 0.0, 0.0, "METERED", None) for k, a in enumerate(lines)]
    schema = "source_id string, address string, latitude double, longitude double, parking_type string, time_limit string"
    spots = normalize.project_spots(spark.createDataFrame(rows, schema), "CITY", F.lit(None).cast("timestamp"))
    assert [r.street_name for r in spots.orderBy("external_id").collect()] == ["3RD ST", "24TH ST", "24th St", "Main St", "Main St"]


@pytest.mark.parametrize(
    ("at", "days", "hours", "holds"),
    [
        ("2024-01-15 09:15:00", None, None, True),  # a Monday
        ("2024-01-15 09:15:00", "Mon,Wed", "800-1800", True),
        ("2024-01-15 18:00:00", "Mon,Wed", "800-1800", False),
        ("2024-01-16 09:15:00", "Mon,Wed", "800-1800", False),
        ("2024-01-15 09:15:00", "M-F", "8:00 - 18:00", True),
        ("2024-01-15 09:15:00", "Sat-Mon", None, True),
        ("2024-01-17 09:15:00", "Sat - Mon", None, False),
        ("2024-01-16 01:00:00", "Monday", "2200-600", True),
        ("2024-01-15 01:00:00", "Monday", "2200-600", False),
        ("2024-01-15 09:15:00", "Daily", "all day", True),
        ("2024-01-15 09:15:00", "holidays", "", True),
    ],
)
def test_rule_hours(spark, at, days, hours, holds):
    row = spark.createDataFrame([(at, days, hours)], "at string, d string, h string")
    got = row.select(schedule.in_hours(F.col("at").cast("timestamp_ntz"), F.col("d"), F.col("h"))).first()[0]
    assert got == holds


def test_drift_names_every_field(spark):
    from curbspark.plans import city

    feed = spark.createDataFrame([('{"a":1,"z":2}',), ('{"a":1,"y":2,"z":3}',)], "raw string")
    got = {(r.field, r.state, r.records) for r in city.drift_fields(feed, ["a", "b"]).collect()}
    assert got == {("b", "missing", 0), ("y", "unexpected", 1), ("z", "unexpected", 2)}
