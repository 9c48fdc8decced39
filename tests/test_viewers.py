from __future__ import annotations

import datetime as dt
import random

import pytest

from curbspark.operators.viewers import row_changes, viewer_messages
from curbspark.sources.tables import read_batches
from curbspark.streaming.viewers import viewer_writer

FEED = "seq long, ts timestamp, id long, op string, latitude double, longitude double, status string"
VIEWERS = "viewer_id long, south double, west double, north double, east double, status string"
START = dt.datetime(2024, 1, 1)


def feed_rows(rng, n=400, spots=12):
    out = []
    for k in range(n):
        op = rng.choice(["INSERT", "UPDATE", "UPDATE", "UPDATE", "DELETE"])
        lat, lng = rng.choice([(37.7, -122.4), (37.75, -122.45), (37.8, -122.3), (rng.uniform(-90, 90), rng.uniform(-180, 180))])
        at = START + dt.timedelta(seconds=rng.randrange(n // 2))
        out.append((k, at, rng.choice([1, 1, 1, *range(2, spots)]), op, lat, lng, rng.choice(["AVAILABLE", "OCCUPIED", None])))
    return out + [(n, START, None, "INSERT", 1.0, 1.0, "AVAILABLE"), (n + 1, START, 3, "UPDATE", None, 500.0, "AVAILABLE")]


BOXES = [
    (1, 37.7, -122.45, 37.75, -122.4, None), (2, 37.7, -122.45, 37.75, -122.4, "AVAILABLE"), (3, -90.0, -180.0, 90.0, 180.0, "OCCUPIED"),
    (4, 37.75, -122.45, 37.75, -122.45, None), (5, -10.0, -20.0, 60.0, 30.0, None), (6, 50.0, 0.0, 40.0, 1.0, None), (7, None, 0.0, 1.0, 1.0, None),
]


def told(rows, viewers, snapshot=()):
    """Plays the feed on every viewer's list."""
    state = {r[0]: r[1:] for r in snapshot}
    sees = lambda v, row: (
        row is not None and None not in (row[0], row[1], v[1]) and abs(row[0]) <= 90 and abs(row[1]) <= 180
        and v[1] <= row[0] <= v[3] and v[2] <= row[1] <= v[4] and (v[5] is None or row[2] == v[5])
    )
    out = []
    for seq, at, id_, op, *row in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[1], r[0])):
        before = state.get(id_)
        if op == "DELETE":
            state.pop(id_, None)
        elif op == "INSERT" or id_ in state:
            state[id_] = tuple(row)
        after = state.get(id_)
        for v in viewers:
            saw, now = sees(v, before), sees(v, after)
            if saw or now:
                shown = after if now else (None, None, None)
                out.append((v[0], "UPDATE" if saw and now else "ENTER" if now else "WITHDRAW", id_, at, seq, *shown))
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"max_broadcast_bytes": -1, "hot_rows": 20}])
def test_messages_replay_the_lists(spark, options):
    rng = random.Random(41)
    rows = feed_rows(rng)
    snapshot = [(1, 37.7, -122.4, "AVAILABLE"), (5, 37.72, -122.42, "OCCUPIED"), (None, 1.0, 1.0, "AVAILABLE")]
    start = spark.createDataFrame(snapshot, "id long, latitude double, longitude double, status string")
    got = viewer_messages(row_changes(spark.createDataFrame(rows, FEED), start), spark.createDataFrame(BOXES, VIEWERS), **options)
    wanted = told(rows, BOXES, [s for s in snapshot if s[0]])
    assert sorted(map(tuple, got.collect()), key=repr) == wanted
    assert {w[1] for w in wanted} == {"ENTER", "UPDATE", "WITHDRAW"} and len(wanted) > 300


def test_stream_tells_the_same(spark, tmp_path):
    """Several micro-batches, a restart, and a change that arrives again."""
    rng = random.Random(42)
    rows = sorted(feed_rows(rng, 240), key=lambda r: (r[1], r[0]))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        viewers = spark.createDataFrame(BOXES, VIEWERS)
        parts = [rows[:100], rows[100:130], rows[125:]]
        for part in parts:
            spark.createDataFrame(part, FEED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
            feed = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/feed")
            viewer_writer(feed, viewers, f"{tmp_path}/out", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = read_batches(spark, f"{tmp_path}/out").drop("batch_id")
    assert sorted(map(tuple, got.collect()), key=repr) == told(rows, BOXES)
