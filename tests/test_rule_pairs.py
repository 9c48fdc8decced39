"""Pairs of spots and rules against plain Python, with ids that repeat or are null."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from curbspark.plans import rules
from tests.test_envelopes import RULES, SPOTS, meters


def drawn(rng, repeated):
    near = lambda: (37.78 + rng.uniform(-4, 4) * 1e-4, -122.41 + rng.uniform(-4, 4) * 1e-4)
    some = lambda i, n: rng.choice([None, rng.randrange(n)]) if repeated and i % 9 == 0 else 100 + i
    face = lambda: rng.choice([None, "A", "B", "C"])
    spots = [(some(i, 5), face(), *near()) for i in range(60)]
    curb = [(some(i, 4), face(), rng.choice("xyz"), rng.choice([None, 0, 1]), *near(), rng.random() < 0.8) for i in range(50)]
    return spots, curb


@pytest.mark.parametrize("repeated", [False, True])
def test_pairs_are_distinct_and_whole(spark, repeated):
    rng = random.Random(31)
    spots, curb = drawn(rng, repeated)
    wanted = {
        (sid, rid)
        for sid, face, lat, lng in spots
        for rid, f, _, _, y, x, on in curb
        if on and ((f is not None and f == face) or meters(lat, lng, y, x) <= 25)
    }
    spot_rows, rule_rows = spark.createDataFrame(spots, SPOTS), spark.createDataFrame(curb, RULES)
    got = rules.spot_rules(spot_rows, rule_rows)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, wanted))
    if not repeated:
        # Nothing gathers pairs to find those that are there twice.
        assert "keys=[spot_id" not in got._jdf.queryExecution().executedPlan().toString()
    detailed = rules.detailed_rules(spot_rows, rule_rows)
    old = rules.with_rule(got, rule_rows).select(detailed.columns)
    assert sorted(map(str, detailed.collect())) == sorted(map(str, old.collect()))
    plain = rules.strictest_rule(old).select("spot_id", "rule_id", "priority")
    chosen = rules.strictest_rule(detailed, rule_rows).select("spot_id", "rule_id", "priority")
    assert sorted(map(str, chosen.collect())) == sorted(map(str, plain.collect()))


def test_strictest_reduces_in_hash_aggregates(spark):
    spots, curb = drawn(random.Random(37), False)
    spot_rows, rule_rows = spark.createDataFrame(spots, SPOTS), spark.createDataFrame(curb, RULES).withColumn("imported_at", F.current_timestamp())
    found = rules.strictest_ids(rules.detailed_rules(spot_rows, rule_rows), at=F.col("imported_at"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    assert sum(r.rule_count for r in found.collect()) == rules.spot_rules(spot_rows, rule_rows).count()
