"""The strictest rule from folded rules against plain Python over all pairs."""

from __future__ import annotations

import math
import random

import pytest

from curbspark.plans import envelopes, rules

RULES = "id long, blockface_id string, regulation_type string, priority int, anchor_latitude double, anchor_longitude double, is_active boolean"
SPOTS = "id long, blockface_id string, latitude double, longitude double"


def meters(lat1, lng1, lat2, lng2):
    a, b = math.radians(lat1), math.radians(lat2)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lng2 - lng1) / 2) ** 2
    return 6371000 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def on_globe(lat, lng):
    return lat is not None and lng is not None and -90 <= lat <= 90 and -180 <= lng <= 180


def plain(spots, curb, reach):
    out = {}
    for sid, face, lat, lng in spots:
        held = [
            (-99 if p is None else p, rid)
            for rid, f, _, p, y, x, on in curb
            if on and ((f is not None and f == face) or (on_globe(lat, lng) and on_globe(y, x) and meters(lat, lng, y, x) <= reach))
        ]
        if held:
            out[sid] = max(held)[1]
    return out


def around(rng, place, reach):
    lat, lng = place
    y = lat + rng.uniform(-2, 2) * reach / 111_195
    x = lng + rng.uniform(-2, 2) * reach / 111_195 / max(math.cos(math.radians(lat)), 1e-4)
    return max(-90.0, min(90.0, y)), (x + 180) % 360 - 180


@pytest.mark.parametrize("reach", [25, 4000])
def test_strictest_against_plain(spark, reach):
    rng = random.Random(reach)
    places = [(37.78, -122.41), (0.0, 0.0), (65.1, 179.99999), (-90.0, 10.0), (89.9999, -30.0), (84.0, -180.0)]
    hot = around(rng, places[0], reach)
    spots, curb = [], []
    for i in range(400):
        lat, lng = hot if i % 4 == 0 else around(rng, rng.choice(places), reach)
        if i % 31 == 0:
            lat, lng = rng.choice([(None, lng), (lat, None), (95.0, lng), (float("nan"), 0.0)])
        spots.append((i, rng.choice([None, "A", "B", "none"]) if i % 3 == 0 else None, lat, lng))
    for i in range(300):
        lat, lng = around(rng, places[0], 1) if i % 5 == 0 else around(rng, rng.choice(places), reach)
        if i % 29 == 0:
            lat, lng = rng.choice([(None, None), (lat, 181.0)])
        face = rng.choice(["A", "B", "C"]) if i % 10 == 0 else None
        curb.append((i, face, "RPP", rng.choice([None, 0, 1, 2, 3]), lat, lng, rng.random() < 0.9))
    spot_rows, rule_rows = spark.createDataFrame(spots, SPOTS), spark.createDataFrame(curb, RULES)
    wanted = plain([s for s in spots if s[2] is None or not math.isnan(s[2])], curb, reach)
    got = envelopes.strictest_rules(spot_rows, rule_rows, reach)
    assert {r.spot_id: r.rule_id for r in got.collect() if r.spot_id in wanted} == wanted
    # Against the pairs, spots with unusable coordinates included.
    pairs = rules.with_rule(rules.spot_rules(spot_rows, rule_rows, reach), rule_rows)
    by_pairs = {(r.spot_id, r.rule_id, r.priority) for r in rules.strictest_rule(pairs).collect()}
    assert {(r.spot_id, r.rule_id, r.priority) for r in got.collect()} == by_pairs
    # Joins through the exchange, with a hot spot's cell salted, give the same.
    spread = envelopes.strictest_rules(spot_rows, rule_rows, reach, max_broadcast_bytes=0, hot_rows=20)
    assert {(r.spot_id, r.rule_id, r.priority) for r in spread.collect()} == by_pairs


def test_many_rules_fold_before_spots(spark):
    """Of 2,000 rules over one corner a spot's cell keeps one row and few border anchors."""
    rng = random.Random(2)
    curb = [(i, None, "RPP", rng.randrange(50), 37.78 + rng.uniform(-3, 3) * 1e-5, -122.41, True) for i in range(2000)]
    rule_rows = spark.createDataFrame(curb, RULES)
    miles = 25 / 1609.344
    step = math.degrees(0.025 / 6371) / envelopes.SPLIT
    inner, border = envelopes.anchor_envelopes(rule_rows, miles, step)
    assert inner.groupBy("_row", "_cell").count().where("count > 1").isEmpty()
    at_corner = envelopes.grid_cell(spark.createDataFrame([(1, 37.78, -122.41)], "id int, latitude double, longitude double"), step)
    cell = at_corner.collect()[0]
    here = f"_row = {cell._row} and _cell = {cell._cell}"
    best = max((r[3], r[0]) for r in curb)
    assert [(r.priority, r.rule_id) for r in inner.where(here).collect()] == [best] and border.where(here).count() == 0
    plan = envelopes.strictest_rules(
        spark.createDataFrame([(1, None, 37.78, -122.41)], SPOTS), rule_rows
    )._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "NestedLoop" not in plan


def test_empty_sides(spark):
    none, some = spark.createDataFrame([], SPOTS), spark.createDataFrame([(1, "A", 37.0, -122.0)], SPOTS)
    no_rules = spark.createDataFrame([], RULES)
    one = spark.createDataFrame([(5, "A", "RPP", None, None, None, True)], RULES)
    assert envelopes.strictest_rules(none, one).count() == 0 and envelopes.strictest_rules(some, no_rules).count() == 0
    assert [tuple(r) for r in envelopes.strictest_rules(some, one).collect()] == [(1, 5, None)]
