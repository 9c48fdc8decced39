"""Snapshot diffs against plain Python, and the log of an import run."""

from __future__ import annotations

import random

from curbspark.operators.diff import change_counts, diff_tables, snapshot_diff
from curbspark.plans import city
from tests.test_feed import NAMES, at, city_feeds, feed_of, tables

SCHEMA = "k string, j int, a string, b double, t timestamp, n array<string>, seen int"


def plain_diff(old, new):
    def held(rows):
        out = {}
        for r in rows:
            out.setdefault(r[:2], []).append(r[2:-1])
        return out

    one, two = held(old), held(new)
    result = {}
    for key in one.keys() | two.keys():
        a, b = one.get(key, []), two.get(key, [])
        if len(a) > 1 or len(b) > 1:
            result[key] = "repeated"
        elif not a or not b:
            result[key] = "deleted" if a else "inserted"
        else:
            result[key] = "unchanged" if repr(a) == repr(b) else "changed"
    return result


def random_rows(rng, n):
    import datetime

    rows = []
    for _ in range(n):
        moment = datetime.datetime(2024, 1, 1, 0, 0, 0, rng.choice([0, 1, 1000]))
        rows.append(
            (
                rng.choice([None, "", "x", "y1", "1"]), rng.choice([None, 0, 1, 11, *range(20, 40)]),
                rng.choice([None, "", "1:a", "a"]), rng.choice([None, 0.5, float("nan")]), rng.choice([None, moment]),
                rng.choice([None, [], ["a, b"], ["a", "b"], [None]]), rng.randrange(9),
            )
        )
    return rows


def test_diff_against_plain(spark):
    rng = random.Random(5)
    for _ in range(3):
        old = random_rows(rng, 90)
        new = [r for r in old if rng.random() < 0.7] + random_rows(rng, 20)
        new = [(*r[:2], rng.choice([r[2], "z"]), *r[3:6], rng.randrange(9)) for r in new]
        got = snapshot_diff(spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA), ["k", "j"], ("seen",))
        assert {(r.k, r.j): r.change for r in got.collect()} == plain_diff(old, new)
        assert got.count() == len(plain_diff(old, new))


def test_values_that_read_alike_differ(spark):
    """Neighbouring texts, null and empty, and instants a microsecond apart."""
    pairs = [("ab", "c", "a", "bc"), (None, "", "", None), ("1:x", None, None, "1:x"), ("", "", None, None)]
    old = spark.createDataFrame([(i, p[0], p[1]) for i, p in enumerate(pairs)], "k int, a string, b string")
    new = spark.createDataFrame([(i, p[2], p[3]) for i, p in enumerate(pairs)], "k int, a string, b string")
    assert {r.change for r in snapshot_diff(old, new, ["k"]).collect()} == {"changed"}
    for kind in ("timestamp", "timestamp_ntz", "struct<x: timestamp_ntz>"):
        one, two = (
            spark.sql(f"select 1 as k, {'named_struct(' + repr('x') + ', ' + m + ')' if 'struct' in kind else m} as v")
            for m in (f"cast('2024-01-01 00:00:00.00000{n}' as {'timestamp_ntz' if 'struct' in kind else kind})" for n in (1, 2))
        )
        assert [r.change for r in snapshot_diff(one, two, ["k"]).collect()] == ["changed"]
        assert [r.change for r in snapshot_diff(one, one, ["k"]).collect()] == ["unchanged"]


def test_empty_snapshots_and_plan(spark):
    none = spark.createDataFrame([], SCHEMA)
    rows = [(f"k{i}", i, *r[2:]) for i, r in enumerate(random_rows(random.Random(1), 3))]
    some = spark.createDataFrame(rows, SCHEMA)
    assert snapshot_diff(none, none, ["k", "j"]).count() == 0
    assert {r.change for r in snapshot_diff(none, some, ["k", "j"]).collect()} == {"inserted"}
    assert {r.change for r in snapshot_diff(some, none, ["k", "j"]).collect()} == {"deleted"}
    diff = diff_tables({"a": some, "b": none}, {"a": some, "b": some}, {"a": ["k", "j"], "b": ["k"]})
    plan = diff._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("Exchange hashpartitioning") == 1
    counts = {r.target: r for r in change_counts(diff).collect()}
    assert counts["a"].unchanged == some.count() and counts["b"].deleted == 0


def log_of(result):
    return {(r.target_table, r.source_dataset): r for r in result["log"].collect()}


def numbers(r):
    return (
        r.status, r.rows_fetched, r.rows_inserted, r.rows_updated, r.rows_unchanged, r.rows_deleted, r.rows_skipped, r.rows_repeated
    )


METERS, BLOCKS = ("city_parking_meters", "8vzz-qzz9"), ("city_parking_blocks", "27b3-yjjx")
RULES, PLACES = ("city_parking_blocks", "hi6h-neyh"), ("normalized_parking_locations", "8vzz-qzz9")


def test_log_of_runs(spark, tmp_path):
    """A first run inserts, a second finds all unchanged, a third sees rows change and go."""
    first = city.run_import(spark, city_feeds(spark), tables(spark), str(tmp_path / "one"), at())
    got = {k: numbers(r) for k, r in log_of(first).items()}
    assert got == {
        BLOCKS: ("success", 1, 1, 0, 0, 0, 0, 0),
        METERS: ("partial", 6, 5, 0, 0, 0, 1, 0),
        RULES: ("partial", 2, 1, 0, 0, 0, 1, 0),
        PLACES: ("success", 5, 5, 0, 0, 0, 0, 0),
    }
    kept = {n: first[f"tables.{n}"] for n in NAMES}
    second = city.run_import(spark, city_feeds(spark), kept, str(tmp_path / "two"), at())
    assert {k: numbers(r)[2:6] for k, r in log_of(second).items()} == {
        BLOCKS: (0, 0, 1, 0), METERS: (0, 0, 5, 0), RULES: (0, 0, 1, 0), PLACES: (0, 0, 5, 0)
    }
    feeds = city_feeds(spark) | {
        "meters": feed_of(spark, [{"post_id": "P0", "lat": 37, "lng": -122, "blockface": "A"}, {"post_id": "P1", "lat": 38, "lng": -122}]),
        "regulations": feed_of(spark, [{"blockface": "Z"}]),
    }
    third = city.run_import(spark, feeds, kept, str(tmp_path / "three"), at())
    got = {k: numbers(r) for k, r in log_of(third).items()}
    assert got[METERS] == ("success", 2, 0, 1, 1, 3, 0, 0)
    assert got[RULES] == ("partial", 1, 0, 0, 0, 1, 1, 0)
    # Meters that left the feed stay in the table, and so do their locations.
    assert got[PLACES] == ("success", 5, 0, 1, 4, 0, 0, 0)
    gone = {r.key for r in third["changes"].where("change = 'deleted' and target = 'meters'").collect()}
    assert len(gone) == 3 and all("source:datasf_parking_meters" in k for k in gone)
    # A feed cut short tells nothing of the rows that it does not reach.
    fourth = city.run_import(spark, feeds, kept, str(tmp_path / "four"), at(), only=["meters"], limit=1)
    assert numbers(log_of(fourth)[METERS]) == ("success", 1, 0, 0, 1, 0, 0, 0)
    assert not {BLOCKS, RULES} & log_of(fourth).keys()


def test_log_of_a_stopped_feed(spark, tmp_path):
    fields = {"meters": ["post_id", "lat", "lng", "jurisdiction"]}
    result = city.run_import(spark, city_feeds(spark), tables(spark), str(tmp_path / "out"), at(), expected=fields)
    row = log_of(result)[METERS]
    assert numbers(row) == ("failed", 6, 0, 0, 0, 0, 0, 0)
    assert row.error_message == "missing: jurisdiction; unexpected: blockface"
    assert log_of(result).keys() == {METERS, BLOCKS, RULES}
    alone = city.run_import(
        spark, city_feeds(spark), tables(spark), str(tmp_path / "alone"), at(), only=["meters"], expected=fields, dry_run=True
    )
    assert [r.status for r in alone["log"].collect()] == ["failed"] and "changes" not in alone
