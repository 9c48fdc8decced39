from __future__ import annotations

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from curbspark.plans import rules
from curbspark.plans.zone_cover import LEVELS, zone_index


def inside(lat, lng, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
            if (y1 > lat) != (y2 > lat) and lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def star(rng, lng, lat, radius, corners):
    at = sorted(rng.uniform(0, 2 * math.pi) for _ in range(corners))
    ring = [[lng + radius * rng.uniform(0.2, 1) * math.cos(a), lat + radius * rng.uniform(0.2, 1) * math.sin(a)] for a in at]
    return [*ring, ring[0]]


def shapes(rng):
    """Zones of a few metres up to a continent, with many corners, holes and parts, a sliver, and one on cell borders."""
    out = []
    for k, radius in enumerate([0.0005, 0.003, 0.02, 0.02, 0.2, 3.0, 40.0]):
        lng, lat = (-122.4 + rng.uniform(-0.01, 0.01), 37.78) if radius < 1 else (10.0, 20.0)
        out.append((k, [[star(rng, lng, lat, radius, 12 + 40 * (k == 3)), star(rng, lng, lat, radius * 0.15, 5)]]))
    out.append((20, [[star(rng, -122.41, 37.77, 0.004, 7)], [star(rng, -122.39, 37.79, 0.004, 7)]]))
    out.append((21, [[[[-122.45, 37.7], [-122.35, 37.8000001], [-122.45, 37.70000012], [-122.45, 37.7]]]]))
    size = 360 / 2**14
    west, south = -180 + 2622 * size, -90 + 5815 * size
    out.append((22, [[[[west, south], [west + size, south], [west + size, south + size], [west, south + size], [west, south]]]]))
    out.append((23, [[[[-180, -80], [180, -80], [180, 80], [-180, 80], [-180, -80]]]]))
    return out


@pytest.fixture(scope="module")
def zoned(spark):
    rng = random.Random(21)
    parts = shapes(rng)
    rows = [(k, json.dumps({"type": "MultiPolygon", "coordinates": p}), True) for k, p in parts] + [
        (98, json.dumps({"type": "MultiPolygon", "coordinates": parts[2][1]}), False),
        (99, None, True),
        (100, '{"type":"Polygon","coordinates":[]}', True),
        (101, '{"type":"Polygon","coordinates":[[[1.0,1.0]]]}', True),
    ]
    zones = rules.with_rings(spark.createDataFrame(rows, "id long, boundary_geojson string, is_active boolean"))
    return {k: [r for part in p for r in part] for k, p in parts}, zones


@pytest.mark.parametrize("options", [{}, {"max_broadcast_bytes": -1, "hot_rows": 50}])
def test_zones_equal_the_point_test(spark, zoned, options):
    rings, zones = zoned
    rng = random.Random(22)
    at = [(37.78 + rng.gauss(0, 10 ** rng.uniform(-4, 1)), -122.4 + rng.gauss(0, 10 ** rng.uniform(-4, 1))) for _ in range(1500)]
    at += [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(300)] + [(37.78, -122.4)] * 100
    # Corners, points between corners, and points a rounding away from them.
    for ring in (r for k, rs in rings.items() if k != 23 for r in rs):
        for (x1, y1), (x2, y2) in zip(ring[:6], ring[1:], strict=False):
            at += [(y1, x1), ((y1 + y2) / 2, (x1 + x2) / 2), (math.nextafter(y1, 90), x1), (y1, math.nextafter(x1, -180))]
    spots = spark.createDataFrame([(i, *p) for i, p in enumerate(at)] + [(-1, None, 0.0), (-2, 95.0, 0.0)], "id long, latitude double, longitude double")
    got = sorted((r.spot_id, r.zone_id) for r in rules.zones_of_points(spots, zones, **options).collect())
    wanted = sorted((i, k) for i, (lat, lng) in enumerate(at) if abs(lat) <= 90 for k, rs in rings.items() if inside(lat, lng, rs))
    assert got == wanted and len(wanted) > 500


def test_cells_vary_in_size_and_do_not_overlap(spark, zoned):
    _, zones = zoned
    cover = zone_index(zones, rules.in_rings).cover
    sizes = cover.where("inner").groupBy("zone_id").agg(F.countDistinct("level").alias("n")).agg(F.max("n")).first()[0]
    assert sizes >= 2 and cover.agg(F.max("level")).first()[0] <= LEVELS[-1]
    assert cover.groupBy("zone_id", "level", "row", "col").count().where("count > 1").isEmpty()
    # No cell lies within a larger one of its zone.
    larger = cover.withColumnsRenamed({"level": "l", "row": "r", "col": "c"})
    within = F.expr("l < level AND r = shiftright(row, level - l) AND c = shiftright(col, level - l)")
    assert cover.join(larger, "zone_id").where(within).isEmpty()
    # Even a zone with many corners has a bounded cover.
    assert cover.groupBy("zone_id").count().agg(F.max("count")).first()[0] < 3000


def test_one_index_serves_many_lookups(spark, zoned):
    _, zones = zoned
    index = zone_index(zones, rules.in_rings)
    spots = spark.createDataFrame([(1, 37.78, -122.4)], "id long, latitude double, longitude double")
    assert rules.zones_of_points(spots, zones, index).collect() == rules.zones_of_points(spots, zones).collect()
