from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from curbspark.operators.asof import status_as_of

REPORTS = "id long, user_id long, parking_spot_id long, status string, created_at timestamp_ntz"
PROBES = "probe_id long, parking_spot_id long, at timestamp_ntz, status string"
START = dt.datetime(2024, 1, 1)


def moment(rng, days=6):
    return START + dt.timedelta(minutes=rng.randrange(days * 1440 // 7) * 7)


def answer(reports, spot, at, ttl):
    known = [r for r in reports if None not in (r[2], r[4]) and r[2] == spot and r[3] in ("AVAILABLE", "OCCUPIED", "UNKNOWN") and at and r[4] <= at]
    last = max(known, key=lambda r: (r[4], r[0]), default=None)
    if last is None or ttl and last[4] < at - ttl:
        return "UNKNOWN", None
    return last[3], last[4]


@pytest.mark.parametrize("ttl", [None, dt.timedelta(hours=5)])
@pytest.mark.parametrize("slice_seconds", [600, 86_400, 10**9])
def test_every_probe_takes_the_last_report(spark, ttl, slice_seconds):
    rng = random.Random(31)
    # Spot 1 has half of all rows; equal times, unknown spots, statuses that do not count, nulls.
    spot = lambda: rng.choice([1, 1, 1, 2, 3, 4, None])
    reports = [(k, 1, spot(), rng.choice(["AVAILABLE", "OCCUPIED", "UNKNOWN", "TAKEN", None]), rng.choice([moment(rng), moment(rng), None])) for k in range(400)]
    probes = [(k, rng.choice([spot(), 9]), rng.choice([moment(rng, 7), moment(rng, 7), reports[k][4]]), "old") for k in range(300)]
    probes += probes[:5]
    given = None if ttl is None else F.make_dt_interval(hours=F.lit(5))
    asked = spark.createDataFrame(probes, PROBES).drop("status")
    got = status_as_of(spark.createDataFrame(reports, REPORTS), asked, given, slice_seconds=slice_seconds)
    assert got.columns == ["probe_id", "parking_spot_id", "at", "status", "reported_at"]
    wanted = [(p[0], p[1], p[2], *answer(reports, p[1], p[2], ttl)) for p in probes]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(wanted, key=repr)


def test_empty_sides(spark):
    reports, probes = spark.createDataFrame([], REPORTS), spark.createDataFrame([(1, 2, START, None)], PROBES).drop("status")
    assert [tuple(r)[3:] for r in status_as_of(reports, probes).collect()] == [("UNKNOWN", None)]
    assert status_as_of(reports, probes.limit(0)).collect() == []
