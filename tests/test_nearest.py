from __future__ import annotations

import random

import pytest

from curbspark.operators.nearest import _boxes, _searched, nearest_places, with_cell
from tests.test_radius import miles, scattered

PLACES = "id long, latitude double, longitude double, name string"
POINTS = "point_id long, point_latitude double, point_longitude double"


def brute_force(points, places, k):
    out = []
    for i, lat, lng in points:
        if lat is None or lng is None or abs(lat) > 90 or abs(lng) > 180:
            continue
        ranked = sorted((miles(lat, lng, q[1], q[2]), q[0]) for q in places if q[1] is not None and abs(q[1]) <= 90)
        out += [(i, key, n, round(d, 6)) for n, (d, key) in enumerate(ranked[:k], 1)]
    return sorted(out)


def searched(spark, points, places, k):
    got = nearest_places(
        spark.createDataFrame(points, POINTS), spark.createDataFrame(places, PLACES), k, point_key="point_id", location_key="id"
    )
    assert "name" in got.columns
    return sorted((r.point_id, r.id, r.nearness, round(r.distance_miles, 6)) for r in got.collect())


@pytest.mark.parametrize("k", [1, 4])
def test_any_distance_equals_brute_force(spark, k):
    """Clusters of every density, the date line, both poles, an empty half of the globe, points and places that repeat."""
    rng = random.Random(11)
    spots = [
        *scattered(rng, 300, 37.78, -122.4, 0.05), *scattered(rng, 40, 37.78, -122.4, 2.0), *scattered(rng, 30, 0.0, 180.0, 1.0),
        *scattered(rng, 30, 89.8, 0.0, 0.2), *scattered(rng, 10, -89.9, 90.0, 0.1), (90.0, 180.0), (-90.0, -180.0), (0.0, 180.0),
    ]
    spots += [(37.78, -122.4)] * 30
    places = [(i, *p, f"n{i}") for i, p in enumerate(spots)] + [(9001, None, 1.0, "x"), (9002, 95.0, 1.0, "y")]
    at = [*scattered(rng, 40, 37.78, -122.4, 0.1), *scattered(rng, 40, 0.0, 0.0, 90.0), *scattered(rng, 10, 0.0, -179.9, 0.3)]
    at += [(90.0, 0.0), (-90.0, 10.0), (37.78, -122.4), (37.78, -122.4), (0.0, -180.0), (45.0, 60.0), (89.9, 179.0)]
    points = [(i, *p) for i, p in enumerate(at)] + [(500, None, 1.0), (501, 1.0, None), (502, 91.0, 0.0), (503, float("nan"), 0.0)]
    wanted = brute_force([p for p in points if p[1] == p[1]], places, k)
    assert searched(spark, points, places, k) == wanted


def test_fewer_places_than_wanted_and_none(spark):
    points = [(1, 10.0, 10.0), (2, -10.0, 179.0)]
    places = [(7, 10.0, 11.0, "a"), (8, 50.0, -170.0, "b")]
    assert searched(spark, points, places, 5) == brute_force(points, places, 5)
    assert searched(spark, points, [], 5) == [] == searched(spark, [], places, 5)


def test_hot_place_and_hot_point(spark):
    places = [(i, 37.0, -122.0, "a") for i in range(2000)] + [(5000 + i, 37.0 + i / 1e4, -122.0, "b") for i in range(50)]
    points = [(i, 37.0, -122.0) for i in range(2000)]
    got = searched(spark, points, places, 3)
    assert got == [(i, j, j + 1, 0.0) for i in range(2000) for j in range(3)]


def test_bad_count_is_refused(spark):
    with pytest.raises(ValueError, match="invalid number"):
        searched(spark, [], [], 0)


def test_far_points_keep_few_cells_of_a_cluster(spark):
    """Cells are pruned by their distance, not by how far they lie to the north and east."""
    rng = random.Random(5)
    places = [(i, *p, "n") for i, p in enumerate(scattered(rng, 3000, 37.75, -122.45, 0.05))]
    points = [(i, *p) for i, p in enumerate(scattered(rng, 60, 0.0, 0.0, 85.0))]
    place_rows = with_cell(spark.createDataFrame(places, PLACES), "latitude", "longitude")
    point_rows = with_cell(spark.createDataFrame(points, POINTS), "point_latitude", "point_longitude")
    wanted, counts = _boxes(point_rows, "point_latitude", "point_longitude"), _boxes(place_rows, "latitude", "longitude")
    per_cell = [r["count"] for r in _searched(wanted, counts, 3).groupBy("row", "col").count().collect()]
    assert len(per_cell) == 60 and sum(per_cell) < 60 * 30
    assert searched(spark, points, places, 3) == brute_force(points, places, 3)
