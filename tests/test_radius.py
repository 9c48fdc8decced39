from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from curbspark.functions import geo
from curbspark.operators import radius_join as radius
from curbspark.operators import serving
from curbspark.operators.radius_join import nearest_per_point, radius_join


def miles(lat1, lng1, lat2, lng2):
    a = (
        math.sin(math.radians(lat2 - lat1) / 2) ** 2
        + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lng2 - lng1) / 2) ** 2
    )
    return 6371 * 2 * math.atan2(math.sqrt(a), math.sqrt(1 - a)) / 1.609344


def scattered(rng, n, lat, lng, spread):
    return [
        (max(-90.0, min(90.0, lat + rng.uniform(-spread, spread))), (lng + rng.uniform(-spread, spread) + 540) % 360 - 180)
        for _ in range(n)
    ]


@pytest.mark.parametrize(
    "lat, lng, spread, radius",
    [(37.78, -122.4, 0.05, 0.5), (0.0, 180.0, 0.5, 10.0), (89.6, 10.0, 0.4, 20.0), (-89.9, 0.0, 0.1, 5.0), (60.0, -179.9, 0.4, 8.0), (37.0, 10.0, 2.0, 200.0)],
)
@pytest.mark.parametrize("salted", [False, True])
def test_pairs_equal_brute_force(spark, lat, lng, spread, radius, salted):
    rng = random.Random(7)
    places = scattered(rng, 150, lat, lng, spread) + [(lat, lng)] * 5
    points = scattered(rng, 25, lat, lng, spread)
    left = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "id long, latitude double, longitude double")
    right = spark.createDataFrame(
        [(i, *p) for i, p in enumerate(points)], "point_id long, point_latitude double, point_longitude double"
    )
    options = {"max_broadcast_bytes": -1 if salted else 1 << 99, "hot_rows": 10}
    got = radius_join(right, left, radius, location_key="id", **options).select("point_id", "id").collect()
    pairs = [(r.point_id, r.id) for r in got]
    wanted = [
        (i, j) for i, p in enumerate(points) for j, q in enumerate(places) if miles(*p, *q) <= radius
    ]
    assert sorted(pairs) == wanted


@pytest.mark.parametrize("center", [(37.7879, -122.4075), (0.0, 179.99), (89.99, 0.0), (-60.0, -179.999)])
def test_unclipped_search_equals_brute_force(spark, center):
    rng = random.Random(3)
    places = scattered(rng, 400, *center, 0.3)
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "id long, latitude double, longitude double")
    found = {r.id for r in serving.within_radius(df, *center, 8.0, clip_box=False).collect()}
    assert found == {i for i, p in enumerate(places) if miles(*center, *p) <= 8.0}
    clipped = {r.id for r in serving.within_radius(df, *center, 8.0).collect()}
    assert clipped <= found
    assert serving.radius_leaks(serving.within_radius(df, *center, 8.0), 8.0).collect()[0].leaks == 0


def test_invalid_points_pair_with_nothing(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0), (3, 95.0, 0.0)], "id long, latitude double, longitude double")
    right = spark.createDataFrame([(1, 0.0, 0.0), (2, float("nan"), 0.0)], "point_id long, point_latitude double, point_longitude double")
    assert [(r.point_id, r.id) for r in radius_join(right, left, 1.0, location_key="id").collect()] == [(1, 1)]


def test_arguments(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0)], "id long, latitude double, longitude double")
    for lat, lng, r in ((999, 0, 1), (0, 200, 1), (float("nan"), 0, 1), (0, 0, 0), (0, 0, -1), (0, 0, float("inf"))):
        with pytest.raises(ValueError):
            serving.nearest(df, lat, lng, r)
    assert serving.nearest(df, 0.0, 0.0, 1.0, limit=0).count() == 1
    with pytest.raises(ValueError):
        serving.newest_in_city(df, "  ")


def test_by_id_fails_when_absent(spark):
    df = spark.range(3)
    assert serving.by_id(df, 2).collect()[0].id == 2
    with pytest.raises(Exception, match="no row with id = 9"):
        serving.by_id(df, 9).collect()


def test_search_rules(spark):
    spots = spark.createDataFrame([(1, "Oak St", None), (2, "Elm St", "9 OAK Alley"), (3, "50% St", "x")], "id int, street_name string, address string")

    def ids(q):
        return [r.id for r in serving.search_text(spots, q).orderBy("id").collect()]

    assert ids("oak") == [1, 2] and ids("  ") == [1, 2, 3] and ids("%") == [3] and ids(" oak ") == [2]
    assert serving.own_rows(spots, None, "id").count() == 0
    assert serving.by_chip(spots, "FAVORITES").count() == 0


def test_nearest_per_point_is_the_head_of_all_pairs(spark):
    """Also at the poles, across the date line, with ties and with fewer places than asked for."""
    places = [(k, lat, lng) for k, (lat, lng) in enumerate([(89.999, 10.0), (89.999, -170.0), (90.0, 0.0), (0.0, 179.999), (0.0, -179.999), (0.0, 179.999), (37.0, -122.0), (-89.9995, 55.0)])]
    points = [("north", 90.0, 33.0), ("line", 0.0, 180.0), ("city", 37.001, -122.001), ("south", -90.0, 0.0), ("none", 10.0, 10.0), ("bad", 91.0, 0.0)]
    locations = spark.createDataFrame(places, "id long, latitude double, longitude double")
    asked = spark.createDataFrame(points, "point_id string, point_latitude double, point_longitude double")
    pairs = radius_join(asked, locations, 1.0, location_key="id").collect()
    wanted = set()
    for point in {r.point_id for r in pairs}:
        near = sorted((r.distance_miles, r.id) for r in pairs if r.point_id == point)[:2]
        wanted |= {(point, place, k) for k, (_, place) in enumerate(near, 1)}
    got = nearest_per_point(asked, locations, 1.0, 2, point_key="point_id", location_key="id")
    assert {(r.point_id, r.id, r.nearness) for r in got.collect()} == wanted
    assert {p for p, _, _ in wanted} == {"north", "line", "city", "south"}
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_nearest_per_point_makes_no_pairs(spark, monkeypatch):
    """Crowded places, keys that repeat or are null, and points of one key at several places."""

    def refused(*args, **kwargs):
        raise AssertionError("all pairs were made")

    rng = random.Random(19)
    places = [(rng.choice([None, *range(300)]), *p, f"n{i % 7}") for i, p in enumerate(scattered(rng, 400, 37.78, -122.4, 0.01))]
    points = [(rng.choice([None, 1, 2, 3]), *p) for p in scattered(rng, 12, 37.78, -122.4, 0.012)] + [(9, None, 1.0), (8, 10.0, 10.0)]
    locations = spark.createDataFrame(places, "id long, latitude double, longitude double, name string")
    asked = spark.createDataFrame(points, "point_id long, point_latitude double, point_longitude double")
    wanted = []
    for key in {p[0] for p in points}:
        near = [(miles(*p[1:], *q[1:3]), q[0]) for p in points for q in places if p[0] == key and p[1] is not None]
        near = sorted((x for x in near if x[0] <= 0.5), key=lambda x: (round(x[0], 9), x[1] is not None, x[1] or 0))[:4]
        wanted += [(key, place, k, round(d, 6)) for k, (d, place) in enumerate(near, 1)]
    monkeypatch.setattr(radius, "radius_join", refused)
    got = radius.nearest_per_point(asked, locations, 0.5, 4, point_key="point_id", location_key="id")
    rows = [(r.point_id, r.id, r.nearness, round(r.distance_miles, 6)) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(wanted, key=str) and rows
    assert {"name", "latitude", "point_latitude"} <= set(got.columns)


@pytest.mark.parametrize("lng", [-122.4, 180.0])
def test_many_comparisons_are_shared_by_tasks(spark, lng):
    """A crowded cell is cut into shares; every pair is still found once, and rows of one key stay apart."""
    rng = random.Random(23)
    places = [(i % 200, *p) for i, p in enumerate(scattered(rng, 300, 37.78, lng, 0.002) + scattered(rng, 60, 37.78, lng, 0.1))]
    points = [(i, *p) for i, p in enumerate(scattered(rng, 20, 37.78, lng, 0.02))]
    left = spark.createDataFrame(places, "id long, latitude double, longitude double")
    right = spark.createDataFrame(points, "point_id long, point_latitude double, point_longitude double")
    got = radius_join(right, left, 0.5, location_key="id", pairs_per_task=100)
    assert set(got.columns) == {*left.columns, *right.columns, "distance_miles"}
    tasks = got.select("id", F.spark_partition_id().alias("task")).distinct().groupBy().agg(F.count_distinct("task")).first()[0]
    assert tasks > 5
    pairs = sorted((r.point_id, r.id) for r in got.collect())
    assert pairs == sorted((i, q[0]) for i, *p in points for q in places if miles(*p, *q[1:]) <= 0.5)


def _exchanges(node):
    """Exchanges of rows in a plan that has run, those of its stages included."""
    kind = node.getClass().getSimpleName()
    if kind == "ShuffleExchangeExec":
        yield node
    if kind == "AdaptiveSparkPlanExec":
        yield from _exchanges(node.executedPlan())
    elif kind.endswith("QueryStageExec"):
        yield from _exchanges(node.plan())
    for i in range(node.children().size()):
        yield from _exchanges(node.children().apply(i))


def test_crowded_cells_do_not_multiply_the_exchange(spark):
    """All rows in one place: the blocks of the pairs copy the rows of each side a few times only."""
    rng = random.Random(29)
    places = [(i, *p) for i, p in enumerate(scattered(rng, 300, 37.78, -122.4, 0.0005))]
    points = [(i, *p) for i, p in enumerate(scattered(rng, 200, 37.78, -122.4, 0.0005))]
    left = spark.createDataFrame(places, "id long, latitude double, longitude double")
    right = spark.createDataFrame(points, "point_id long, point_latitude double, point_longitude double")
    got = radius_join(right, left, 0.5, location_key="id", pairs_per_task=100)
    assert sorted((r.point_id, r.id) for r in got.collect()) == [(i, j) for i in range(200) for j in range(300)]
    written = [n.metrics().apply("shuffleRecordsWritten").value() for n in _exchanges(got._jdf.queryExecution().executedPlan())]
    # A point reaches 25 cells of the finer grid; the exchange holds all rows twice at most.
    assert 500 < max(written) <= 2 * (300 + 25 * 200)


@pytest.mark.parametrize(
    "lat, lng, spread, radius",
    [(37.78, -122.4, 0.05, 0.5), (0.0, 180.0, 0.5, 10.0), (89.6, 10.0, 0.4, 20.0), (-89.9, 0.0, 0.1, 5.0), (60.0, -179.9, 0.4, 8.0), (37.0, 10.0, 2.0, 200.0), (5.0, 20.0, 85.0, 5000.0)],
)
def test_blocks_equal_brute_force(spark, lat, lng, spread, radius):
    """Also keys that repeat or are null, equal rows, and points with columns that have no hash."""
    rng = random.Random(31)
    places = [(rng.choice([None, *range(40)]), *p) for p in scattered(rng, 150, lat, lng, spread) + [(lat, lng)] * 60]
    points = [(rng.choice([None, *range(9)]), *p, {"k": 1}) for p in scattered(rng, 25, lat, lng, spread) + [(lat, lng)] * 30]
    left = spark.createDataFrame(places, "id long, latitude double, longitude double")
    right = spark.createDataFrame(points, "point_id long, point_latitude double, point_longitude double, more map<string, int>")
    got = radius_join(right, left, radius, location_key="id", pairs_per_task=50)
    assert got.columns == ["id", "latitude", "longitude", "point_id", "point_latitude", "point_longitude", "more", "distance_miles"]
    pairs = [(r.point_id, r.id, round(r.distance_miles, 6)) for r in got.collect()]
    wanted = [(p[0], q[0], round(miles(*p[1:3], *q[1:]), 6)) for p in points for q in places if miles(*p[1:3], *q[1:]) <= radius]
    assert sorted(pairs, key=str) == sorted(wanted, key=str)


def test_rounded_miles_are_those_of_round(spark):
    rng = random.Random(37)
    values = [k / 2e6 for k in range(200)] + [math.nextafter(k / 2e6, s) for k in range(200) for s in (0, 9)]
    values += [rng.uniform(0, 0.5) for _ in range(3000)] + [rng.uniform(0, 13000) for _ in range(3000)]
    values += [0.0, -0.0, -0.25, -3.1234565, 999999.9999995, 1e6, 1e6 + 0.1234565, 1e15, 1e300, float("inf"), float("-inf"), float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = df.select("x", geo.rounded_miles(F.col("x")).alias("got"), F.round("x", 6).alias("wanted")).collect()
    assert [r.x for r in rows if repr(r.got) != repr(r.wanted)] == []
