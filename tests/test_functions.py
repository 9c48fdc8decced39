from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from curbspark.functions import display, geo, schedule, text
from curbspark.functions.payload import sanitize_payload
from curbspark.plans.normalize import address_line, is_active, restriction_text


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def test_trim_strips_every_kind_of_blank(spark):
    rows = [("  a b 　",), ("\t\n",), ("﻿",), (None,), ("  x",)]
    assert values(spark, rows, "t string", text.non_blank(F.col("t"))) == ["a b", None, None, None, "x"]


def test_first_string_takes_the_next_name_when_blank(spark):
    rows = [((" ", " two "),), (("one", "two"),), ((None, None),)]
    got = values(spark, rows, "r struct<a:string,b:string>", text.first_string(F.col("r"), ["a", "b"]))
    assert got == ["two", "one", None]


def test_numbers(spark):
    rows = [(t,) for t in ("1d", "0x10", "1,2", "Infinity", "-Infinity", "NaN", " ", "", "1e3", " 2.5 ", ".5", "7.", "+1", None)]
    got = values(spark, rows, "t string", text.to_number(F.col("t")))
    assert got == [None, None, None, math.inf, -math.inf, None, None, None, 1000.0, 2.5, 0.5, 7.0, 1.0, None]


def test_blank_and_unreadable_numbers_fall_to_the_next_name(spark):
    rows = [((" ", "2"),), (("x", "3"),), (("1", "3"),)]
    got = values(spark, rows, "r struct<a:string,b:string>", text.first_number(F.col("r"), ["a", "b"]))
    assert got == [2.0, 3.0, 1.0]


def test_containers_have_no_text(spark):
    rows = [('{"a":1}',), ("[1,2]",), ("[Pier 39]",), ("plain",), (None,)]
    assert values(spark, rows, "t string", text.scalar_text(F.col("t"))) == [None, None, "[Pier 39]", "plain", None]


@pytest.mark.parametrize(
    "lat, lng, good",
    [
        (90.0, 180.0, True), (-90.0, -180.0, True), (90.1, 0.0, False), (0.0, 200.0, False), (None, 0.0, False),
        (0.0, None, False), (math.nan, 0.0, False), (0.0, math.nan, False), (math.inf, 0.0, False),
    ],
)
def test_coordinates(spark, lat, lng, good):
    assert values(spark, [(lat, lng)], "a double, b double", geo.valid_coordinate(F.col("a"), F.col("b"))) == [good]
    if lat is not None and lng is not None:
        assert geo.is_point(lat, lng) is good


def test_a_mile_north(spark):
    lat, lng = 37.7879, -122.4075
    far = geo.haversine_miles(F.lit(lat), F.lit(lng), F.col("a"), F.lit(lng))
    assert 0.9 < values(spark, [(lat + 0.0145,)], "a double", far)[0] < 1.1


def test_active_flags(spark):
    flags = ["N", "NO", "INACTIVE", "0", "FALSE", "F", "n", " f ", "Y", "YES", "A", "ACTIVE", "1", "TRUE", "T", "U", " ", None]
    got = values(spark, [(f,) for f in flags], "f string", is_active(F.col("f")))
    assert got == [False] * 8 + [True] * 10


def test_address_and_restrictions(spark):
    rows = [(" 12 ", " Oak St ", "GREY", None, "", "SS"), (None, "Oak St", None, None, None, None), ("12", " ", None, "ON", "X", None)]
    schema = "num string, street string, cap string, place string, area string, kind string"
    assert values(spark, rows, schema, address_line(F.col("num"), F.col("street"))) == [
        "12 Oak St, San Francisco, CA", "Oak St, San Francisco, CA", None,
    ]
    joined = restriction_text(cap_color=F.col("cap"), location=F.col("place"), jurisdiction=F.col("area"), meter_type=F.col("kind"))
    assert values(spark, rows, schema, joined) == ["cap_color:GREY; meter_type:SS", None, "location:ON; jurisdiction:X"]


def test_relative_times(spark):
    now = dt.datetime(2024, 5, 12, 12, 0, 0)
    ages = [59, 60, 59 * 60, 60 * 60, 23 * 3600, 24 * 3600, 50 * 3600]
    rows = [(now - dt.timedelta(seconds=a),) for a in ages] + [(None,)]
    at = F.lit("2024-05-12 12:00:00").cast("timestamp_ntz")
    assert values(spark, rows, "t timestamp_ntz", display.updated_label(F.col("t"), at)) == [
        "Just now", "1 min ago", "59 min ago", "1 hr ago", "23 hr ago", "May 11, 2024", "May 10, 2024", "Never",
    ]
    assert values(spark, rows[:-1], "t timestamp_ntz", display.time_ago(F.col("t"), at)) == [
        "Just now", "1m ago", "59m ago", "1h ago", "23h ago", "1d ago", "2d ago",
    ]


def test_labels(spark):
    rows = [("AVAILABLE",), ("available",), (None,)]
    assert values(spark, rows, "s string", display.status_label(F.col("s"))) == ["Available", "Unknown", "Unknown"]
    assert values(spark, rows, "s string", display.pin_color(F.col("s"))) == ["green", "gray", "gray"]
    assert values(spark, [("$2",), ("2",), (None,)], "p string", display.display_price(F.col("p"))) == ["$2", "$2", None]


def test_payload(spark):
    twelve = "{" + ",".join(f'"k{i}":{i}' for i in range(12)) + "}"
    mixed = '{"b":{"x":1},"a":"{not json}","c":[1],"d":null,"e":true,"f":1.5}'
    rows = [(twelve,), (mixed,), ('{"z":1,"y":2,"z":3}',), ("[1]",), ("text",), (None,), ("{}",)]
    got = values(spark, rows, "p string", sanitize_payload(F.col("p")))
    assert got == [
        "{" + ",".join(f'"k{i}":{i}' for i in range(10)) + "}",
        '{"a":"{not json}","d":null,"e":true,"f":1.5}',
        '{"z":3,"y":2}',
        "{}", "{}", "{}", "{}",
    ]


def test_dropped_values_do_not_count(spark):
    payload = "{" + ",".join(f'"n{i}":[{i}]' for i in range(5)) + "," + ",".join(f'"k{i}":{i}' for i in range(10)) + "}"
    got = values(spark, [(payload,)], "p string", sanitize_payload(F.col("p")))[0]
    assert got == "{" + ",".join(f'"k{i}":{i}' for i in range(10)) + "}"


def test_emails(spark):
    rows = [(" A@B.c ",), ("none",), (" ",), (None,), ("a" * 252 + "@b",), ("a" * 253 + "@b",)]
    assert values(spark, rows, "e string", text.valid_email(F.col("e"))) == [True, False, False, False, True, False]
    assert values(spark, rows[:1], "e string", text.normalize_email(F.col("e"))) == ["a@b.c"]


def test_local_time_follows_daylight_saving(spark):
    rows = [("2024-01-15 20:00:00",), ("2024-07-15 20:00:00",), ("2024-03-10 09:59:00",), ("2024-03-10 10:00:00",)]
    got = values(spark, rows, "t string", schedule.local_time(F.col("t").cast("timestamp")))
    assert got == [
        dt.datetime(2024, 1, 15, 12), dt.datetime(2024, 7, 15, 13), dt.datetime(2024, 3, 10, 1, 59), dt.datetime(2024, 3, 10, 3),
    ]


def test_sweeping_window(spark):
    rows = [
        (dt.datetime(2024, 1, 1, 8, 0), "Monday", "08:00", "10:00", "1,3"),
        (dt.datetime(2024, 1, 1, 10, 0), "Mon", "08:00", "10:00", "1,3"),
        (dt.datetime(2024, 1, 8, 9, 0), "mon", "08:00", "10:00", "1,3"),
        (dt.datetime(2024, 1, 8, 9, 0), "Mon", "08:00", "10:00", " "),
        (dt.datetime(2024, 2, 1, 0, 0), "Thu", "08:00", "10:00", "5"),
        (dt.datetime(2024, 1, 1, 0, 0), "Noday", "08:00", "10:00", None),
    ]
    schema = "t timestamp_ntz, day string, s string, e string, w string"
    cols = [F.col(c) for c in ("t", "day", "s", "e", "w")]
    got = values(spark, rows, schema, F.coalesce(schedule.in_force(*cols), F.lit(False)))
    assert got == [True, False, False, True, False, False]
    starts = values(spark, rows, schema, schedule.next_start(cols[0], cols[1], cols[2], cols[4]))
    assert starts == [
        dt.datetime(2024, 1, 15, 8), dt.datetime(2024, 1, 15, 8), dt.datetime(2024, 1, 15, 8), dt.datetime(2024, 1, 15, 8),
        dt.datetime(2024, 2, 29, 8), None,
    ]
