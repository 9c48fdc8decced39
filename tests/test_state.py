"""Keyed writes, change feeds and operation logs against row-by-row replays."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from curbspark.operators import accounts, changes, favorites, integrity, reports, spot_admin
from curbspark.operators.latest import first_per_key, latest_per_key
from curbspark.operators.upsert import insert_if_absent, upsert
from curbspark.schemas import RULES
from tests.support import spark_rows


def when(day):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day)


def test_latest_and_first(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 5, "c")], "k int, o int, v string")
    assert [tuple(r) for r in latest_per_key(df, ["k"], ["o"]).orderBy("k").collect()] == [(1, 2, None), (2, 5, "c")]
    assert [tuple(r) for r in first_per_key(df, ["k"], ["o"]).orderBy("k").collect()] == [(1, 1, "a"), (2, 5, "c")]


def test_upsert(spark):
    old, new, now = when(0), when(5), F.lit("2024-03-01").cast("timestamp_ntz")
    target = spark.createDataFrame(
        [("a", "id-a", "x", "extra", "MOCK", old, old), ("b", "id-b", "y", "extra", "CITY", old, old), ("c", "id-c", "z", None, "CITY", old, old)],
        "k string, id string, v string, other string, source string, created_at timestamp_ntz, updated_at timestamp_ntz",
    )
    batch = spark.createDataFrame(
        [("a", "new", "v1", new), ("b", "new", None, new), ("d", "new", "v4", new)], "k string, id string, v string, updated_at timestamp_ntz"
    )
    state = upsert(target, batch, ["k"], at=now, keep=["id"], guard=F.col("source") != "MOCK", defaults={"source": F.lit("NEW")}, with_change=True)
    rows = {r.k: r for r in state.collect()}
    assert rows["a"].v == "x" and rows["a"].updated_at == old and rows["a"]._change == "unchanged"
    assert rows["b"].v is None and rows["b"].other == "extra" and rows["b"].id == "id-b"
    assert rows["b"].updated_at == dt.datetime(2024, 3, 1) and rows["b"].created_at == old
    assert rows["c"]._change == "unchanged"
    # An insert keeps the time it brings.
    assert rows["d"].updated_at == new and rows["d"].source == "NEW" and rows["d"]._change == "inserted"
    again = upsert(state.drop("_change"), batch, ["k"], at=now, keep=["id"], guard=F.col("source") != "MOCK")
    repeat = upsert(again, batch, ["k"], at=now, keep=["id"], guard=F.col("source") != "MOCK")
    assert spark_rows(again) == spark_rows(repeat)
    assert upsert(target, batch, ["k"], at=now, insert_new=False).count() == 3


def test_insert_if_absent_splits_the_whole_batch(spark):
    target = spark.createDataFrame([("a",)], "email string")
    batch = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c")], "seq int, email string")
    inserted, already = insert_if_absent(target, batch, ["email"], ["seq"])
    assert sorted(r.seq for r in inserted.collect()) == [2, 4]
    assert sorted(r.seq for r in already.collect()) == [1, 3]


def replay(snapshot, events):
    state = dict(snapshot)
    for _, _, op, key, value in sorted(events, key=lambda e: (e[0], e[1])):
        if key is None:
            continue
        if op == "INSERT" or (op == "UPDATE" and key in state):
            state[key] = value
        elif op == "DELETE":
            state.pop(key, None)
    return state


def random_feed(seed, n=400, keys=40):
    rng = random.Random(seed)
    return [
        (when(rng.randrange(20)), i, rng.choice(["INSERT", "UPDATE", "UPDATE", "DELETE"]), rng.choice([None, *range(keys)]), f"v{i}")
        for i in range(n)
    ]


FEED = "ts timestamp_ntz, seq long, op string, id long, status string"


@pytest.mark.parametrize("seed", range(3))
def test_change_fold_equals_replay(spark, seed):
    snapshot = {k: f"old{k}" for k in range(0, 30)}
    events = random_feed(seed, n=120)
    table = spark.createDataFrame(list(snapshot.items()), "id long, status string")
    feed = spark.createDataFrame(events, FEED)
    wanted = replay(snapshot, events)
    assert {r.id: r.status for r in changes.apply_changes(table, feed).collect()} == wanted
    spread = feed.repartition(13)
    once = changes.apply_changes(table, spread)
    assert {r.id: r.status for r in changes.apply_changes(once, feed).collect()} == wanted


def test_change_fold_by_hand(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (9, "keep")], "id long, status string")
    feed = spark.createDataFrame(
        [
            (when(1), 1, "UPDATE", 5, "early"), (when(2), 2, "INSERT", 5, "born"),
            (when(1), 3, "DELETE", 1, None), (when(2), 4, "UPDATE", 1, "ghost"),
            (when(1), 5, "DELETE", 2, None), (when(2), 6, "INSERT", 2, "again"),
            (when(1), 7, "UPDATE", 7, "nobody"), (when(1), 8, "DELETE", None, None),
        ],
        FEED,
    )
    got = {r.id: r.status for r in changes.apply_changes(table, feed).collect()}
    assert got == {2: "again", 3: "c", 5: "born", 9: "keep"}


def test_a_feed_with_unknown_columns_is_refused(spark):
    feed = spark.createDataFrame(random_feed(1, 5), FEED)
    with pytest.raises(ValueError, match="status"):
        changes.apply_changes(spark.range(3), feed)


def test_messages(spark):
    spots = spark.createDataFrame([(1, "x")], "id long, address string")
    ops = spark.createDataFrame([(1, "UPDATE"), (1, "DELETE"), (2, "CREATE"), (2, "DELETE")], "id long, update_type string")
    got = {(r.update_type, r.id, r.spot.address if r.spot else None) for r in changes.update_messages(ops, spots).collect()}
    assert got == {("UPDATE", 1, "x"), ("DELETE", 1, None), ("DELETE", 2, None)}


def replay_favorites(log):
    state = {}
    for ts, seq, user, spot, op in sorted(log):
        if op == "add":
            state.setdefault((user, spot), (ts, seq))
        else:
            state.pop((user, spot), None)
    return state


LOG = "ts timestamp_ntz, seq long, user_id long, parking_spot_id long, op string"


@pytest.mark.parametrize("salted", [False, True])
def test_favorites_equal_replay(spark, salted):
    rng = random.Random(5)
    log = [(when(rng.randrange(30)), i, rng.choice([1, 1, 2, 3]), rng.randrange(6), rng.choice(["add", "add", "remove"])) for i in range(300)]
    options = {"max_broadcast_bytes": -1, "hot_rows": 5} if salted else {}
    got = favorites.current_favorites(spark.createDataFrame(log, LOG), **options).collect()
    assert {(r.user_id, r.parking_spot_id): (r.created_at, r.seq) for r in got} == replay_favorites(log)


def test_toggles_equal_replay(spark):
    rng = random.Random(6)
    held = [(when(0), -i, 1, i, "add") for i in range(1, 5)]
    requests = [(when(rng.randrange(1, 9)), i, rng.choice([1, 2]), rng.randrange(1, 8)) for i in range(40)]
    state = replay_favorites(held)
    for ts, seq, user, spot in sorted(requests):
        if (user, spot) in state:
            del state[(user, spot)]
        else:
            state[(user, spot)] = (ts, seq)
    log = spark.createDataFrame(held, LOG)
    asked = spark.createDataFrame(requests, "ts timestamp_ntz, seq long, user_id long, parking_spot_id long")
    entries = favorites.toggles(favorites.current_favorites(log), asked)
    got = favorites.current_favorites(log.unionByName(entries)).collect()
    assert {(r.user_id, r.parking_spot_id): (r.created_at, r.seq) for r in got} == state


def test_reports(spark):
    spots = spark.createDataFrame([(1, "UNKNOWN", when(0)), (2, "AVAILABLE", when(0))], "id long, status string, updated_at timestamp_ntz")
    rows = [
        (1, 7, 1, "OCCUPIED", when(3)), (2, 7, 1, "AVAILABLE", when(3)), (3, None, 2, "TAKEN", when(9)),
        (4, 7, 2, "TAKEN", when(9)), (5, 7, 99, "OCCUPIED", when(9)), (6, 7, None, "OCCUPIED", when(9)), (7, 7, 2, None, when(9)),
    ]
    log = spark.createDataFrame(rows, "id long, user_id long, parking_spot_id long, status string, created_at timestamp_ntz")
    state, accepted, rejected = reports.submit_reports(spots, log)
    assert {r.id: (r.status, r.updated_at) for r in state.collect()} == {1: ("AVAILABLE", when(3)), 2: ("AVAILABLE", when(0))}
    assert sorted(r.id for r in accepted.collect()) == [1, 2]
    assert {r.id: r.reject_reason for r in rejected.collect()} == {
        3: "not_authenticated", 4: "invalid_status", 5: "spot_not_found", 6: "spot_not_found", 7: "invalid_status",
    }
    stamped, _, _ = reports.submit_reports(spots, log, F.lit("2024-06-01").cast("timestamp_ntz"))
    assert {r.updated_at for r in stamped.where("id = 1").collect()} == {dt.datetime(2024, 6, 1)}
    now = F.lit("2024-01-04 00:10:00").cast("timestamp_ntz")
    fresh = reports.fresh_status(spots, log, now, 20)
    assert {r.id: r.status for r in fresh.collect()} == {1: "AVAILABLE", 2: "UNKNOWN"}
    assert {r.id: r.status for r in reports.fresh_status(spots, log, now, 5).collect()} == {1: "UNKNOWN", 2: "UNKNOWN"}


def replay_operations(spots, log):
    state, former, refused = dict(spots), set(), {}
    for seq, op, key, address, lat, available, price in sorted(log):
        if op in ("create", "update"):
            problem = (
                "latitude_required" if lat is None
                else "address_required" if not (address or "").strip()
                else "price_not_positive" if price is not None and price <= 0
                else None
            )
            if problem:
                refused[seq] = problem
                continue
        if op == "create":
            if key in state or key in former:
                refused[seq] = "id_taken"
            else:
                state[key] = (address, lat, available, price)
        elif key not in state:
            refused[seq] = "not_found"
        elif op == "update":
            state[key] = (address, lat, available, price)
        elif op == "delete":
            del state[key]
            former.add(key)
        else:
            state[key] = (*state[key][:2], available, state[key][3])
    return state, refused


@pytest.mark.parametrize("salted", [False, True])
def test_spot_operations_equal_replay(spark, salted):
    rng = random.Random(11)
    spots = {k: (f"old {k}", 1.0, True, None) for k in range(20)}
    log = [
        (
            i, rng.choice(["create", "update", "availability", "availability", "delete"]), rng.randrange(60),
            rng.choice(["A st", "B st", " "]), rng.choice([1.5, 2.5, None]), rng.random() < 0.5, rng.choice([None, 1.0, 0.0]),
        )
        for i in range(300)
    ]
    fields = "address string, latitude double, longitude double, available boolean, price double, restrictions string"
    table = spark.createDataFrame([(k, a, lat, 0.0, av, p, None) for k, (a, lat, av, p) in spots.items()], f"id long, {fields}")
    ops = spark.createDataFrame(
        [(s, op, k, a, lat, 0.0, av, p, None) for s, op, k, a, lat, av, p in log], f"seq long, op string, id long, {fields}"
    )
    options = {"max_broadcast_bytes": -1, "hot_rows": 5} if salted else {}
    checked = spot_admin.check_operations(table, ops, **options)
    state, refused = replay_operations(spots, log)
    assert {r.seq: r.reject_reason for r in checked.where("reject_reason is not null").collect()} == refused
    got = spot_admin.apply_operations(table, checked).collect()
    assert {r.id: (r.address, r.latitude, r.available, r.price) for r in got} == state


def test_waitlist_and_profiles(spark):
    waitlist = spark.createDataFrame([("a@b.c",)], "email string")
    signups = spark.createDataFrame(
        [(1, " A@B.c", "x", None), (2, "n@b.c ", " Ann ", " "), (3, "N@B.C", "other", "y"), (4, "bad", "x", "y")],
        "seq int, email string, full_name string, interest string",
    )
    inserted, already, invalid = accounts.join_waitlist(waitlist, signups, ["seq"])
    assert [(r.seq, r.email, r.full_name, r.interest) for r in inserted.collect()] == [(2, "n@b.c", "Ann", None)]
    assert sorted(r.seq for r in already.collect()) == [1, 3] and [r.seq for r in invalid.collect()] == [4]
    updates = spark.createDataFrame(
        [(1, 1, "Al"), (1, 2, "Bo"), (3, 3, " "), (4, 4, "x"), (5, 5, "y" * 101), (None, 6, "No")], "caller_id int, id int, full_name string"
    )
    got = {r.id: r.reject_reason for r in accounts.check_profile_updates(updates).collect()}
    assert got == {
        1: None, 2: "not_own_profile", 3: "full_name_required", 4: "full_name_length", 5: "full_name_length", 6: "not_own_profile",
    }


def test_rules(spark):
    rows = spark.createDataFrame(
        [("1", "s", 1.0, 2.0, "AVAILABLE", "FREE", "MOCK"), ("2", None, 1.0, 2.0, "available", "FREE", "NEWS")],
        "id string, street_name string, latitude double, longitude double, status string, parking_type string, source string",
    )
    good, bad = integrity.split_by_rules(rows, RULES["parking_spots"])
    assert [r.id for r in good.collect()] == ["1"]
    assert bad.collect()[0].violations == ["street_name is null", "status not allowed", "source not allowed"]


@pytest.mark.parametrize("salted", [False, True])
def test_references(spark, salted):
    child = spark.createDataFrame([(1, 1), (2, 2), (3, 9), (4, None), (5, 9)], "id int, spot int")
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    options = {"max_broadcast_bytes": -1, "hot_rows": 2} if salted else {}
    gone = spark.createDataFrame([(2,)], "id int")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(integrity.orphans(child, parent, "spot", salt_by=["id"], **options)) == [3, 5]
    assert ids(integrity.cascade_delete(child, gone, "spot", salt_by=["id"], **options)) == [1, 3, 4, 5]
    blanked = integrity.set_null_on_delete(child, gone, "spot", salt_by=["id"], **options)
    assert {r.id: r.spot for r in blanked.collect()} == {1: 1, 2: None, 3: 9, 4: None, 5: 9}
