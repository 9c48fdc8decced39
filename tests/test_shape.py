"""Sketches of a feed's shape against plain Python, and imports stopped by a change of kind."""

from __future__ import annotations

import collections
import json
import random

from curbspark.plans import city, shape
from tests.test_feed import at, city_feeds, feed_of, tables


def plain_shape(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "BOOLEAN"
    if isinstance(value, (int, float)):
        return "NUMBER"
    return {str: "STRING", dict: "OBJECT", list: "ARRAY"}[type(value)]


def sketch_rows(df):
    return {(r.field, r.shape): r.records for r in df.collect()}


def test_sketch_against_plain(spark):
    rng = random.Random(3)
    values = [None, 1, 2.5, 1e300, True, "", "12", {}, {"a": 1}, [], [1, 2.5], {"b": [{"c": "x"}]}, -0.0, 10**30]
    records = [{rng.choice("abcd é\"."): rng.choice(values) for _ in range(rng.randrange(5))} for _ in range(300)]
    feed = feed_of(spark, records)
    wanted = collections.Counter((f, plain_shape(v)) for r in records for f, v in r.items())
    got = collections.Counter()
    for (field, text), n in sketch_rows(shape.shape_sketch(feed)).items():
        if field is not None:
            got[field, text.split("<")[0]] += n
        else:
            assert (text, n) == (shape.ALL, 300)
    assert got == wanted


def test_nested_shapes_and_bad_records(spark):
    texts = [
        '{"s": {"type": "Point", "coordinates": [-122.4, 37]}, "n": null}', '{"s": {"coordinates": [1, 2.5], "type": "P"}}',
        '{"s": "text"}', "[1]", "oops", "", None, "{}",
    ]
    feed = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "feed_pos int, raw string")
    got = sketch_rows(shape.shape_sketch(feed))
    assert got == {
        (None, shape.ALL): 8, (None, shape.UNREADABLE): 4, ("n", "NULL"): 1, ("s", "STRING"): 1,
        ("s", "OBJECT<coordinates: ARRAY<NUMBER>, type: STRING>"): 2,
    }
    summary = {r.field: r for r in shape.field_summary(shape.shape_sketch(feed)).collect()}
    assert (summary["s"].kinds, summary["s"].records, summary["s"].filled, summary["s"].shapes, summary["s"].depth) == (
        "OBJECT,STRING", 3, 3, 2, 2
    )
    assert (summary["n"].kinds, summary["n"].filled, summary["n"].depth) == ("NULL", 0, 0)
    assert shape.shape_sketch(feed.limit(0)).count() == 0


def test_sketches_add_up(spark):
    rng = random.Random(9)
    records = [{rng.choice("abc"): rng.choice([1, "x", None, [1]])} for _ in range(100)]
    parts = [feed_of(spark, records[:30]), feed_of(spark, records[30:31]), feed_of(spark, records[31:])]
    sketches = [shape.shape_sketch(p) for p in parts]
    merged = shape.merge_sketches(sketches[0].unionByName(sketches[1]).unionByName(sketches[2]))
    assert sketch_rows(merged) == sketch_rows(shape.shape_sketch(feed_of(spark, records)))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_drift_of_shape(spark):
    before = [{"kept": 1, "number": 5, "text": "a", "gone": 1, "often": 1, "null": None, "mixed": 1} for _ in range(10)]
    now = [
        {"kept": 2.5, "number": "5" if i % 5 == 0 else 5, "text": None, "new": 1, "null": None, "mixed": None if i == 0 else 3}
        | ({"often": 1} if i < 8 else {})
        for i in range(10)
    ]
    one, two = (shape.shape_sketch(feed_of(spark, r)) for r in (before, now))
    rows = {r.field: (r.state, r.kinds_before, r.kinds_now) for r in shape.shape_drift(one, two).collect()}
    assert rows == {
        "gone": ("missing", "NUMBER", None),
        "new": ("unexpected", None, "NUMBER"),
        "number": ("retyped", "NUMBER", "NUMBER,STRING"),
        "text": ("sparser", "STRING", "NULL"),
        "often": ("sparser", "NUMBER", "NUMBER"),
    }
    assert "often" not in {r.field for r in shape.shape_drift(one, two, 0.25).collect()}
    assert shape.shape_drift(one, one).count() == 0
    none = shape.shape_sketch(feed_of(spark, before).limit(0))
    assert {r.state for r in shape.shape_drift(none, one).collect()} == {"unexpected"}
    assert {r.state for r in shape.shape_drift(one, none).collect()} == {"missing"}
    assert shape.drift_message(shape.shape_drift(one, one)).collect()[0].error_message is None


def test_import_stops_on_another_kind(spark, tmp_path):
    feeds = city_feeds(spark)
    shapes = {n: shape.shape_sketch(f) for n, f in feeds.items()}
    good = city.run_import(spark, feeds, tables(spark), str(tmp_path / "good"), at(), shapes=shapes)
    assert good["tables.meters"].count() == 5 and not [k for k in good if k.startswith("drift")]
    assert sketch_rows(good["shape.meters"]) == sketch_rows(shapes["meters"])
    changed = [json.loads(r.raw) for r in feeds["meters"].collect()]
    changed[0]["lat"] = {"degrees": 37}
    again = city.run_import(
        spark, feeds | {"meters": feed_of(spark, changed)}, tables(spark), str(tmp_path / "bad"), at(), shapes=shapes
    )
    assert again["tables.meters"].count() == 0 and again["tables.blocks"].count() == 1
    failed = [r for r in again["log"].collect() if r.status == "failed"]
    assert [(r.target_table, r.error_message) for r in failed] == [
        ("city_parking_meters", "retyped lat (NUMBER to NUMBER,OBJECT)")
    ]
