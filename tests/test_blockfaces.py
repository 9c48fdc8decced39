"""Windows per blockface as a stream: late reports, replays, restarts; declared keys."""

from __future__ import annotations

import collections
import datetime
import random

import pytest

from curbspark import schemas
from curbspark.operators import integrity
from curbspark.sources.tables import read_batches
from curbspark.streaming import blockfaces

START = datetime.datetime(2024, 1, 1)
SCHEMA = "id long, user_id long, parking_spot_id long, status string, created_at timestamp_ntz"
FACES = {1: "A", 2: "A", 3: "B", 4: None}


def plain(batches):
    """Counts, late counts, and corrections by (key, batch) of 30-minute windows with a delay of an hour."""
    counts, late, fixes, latest = collections.Counter(), collections.Counter(), {}, None
    for k, batch in enumerate(batches):
        now = collections.Counter()
        for _, _, spot, status, at in batch:
            if at is not None and FACES.get(spot):
                start = at.replace(minute=at.minute // 30 * 30, second=0, microsecond=0)
                now[FACES[spot], start, status] += 1
        for key, n in now.items():
            if latest is not None and key[1] + datetime.timedelta(minutes=90) <= latest:
                late[key] += n
                fixes[(*key, k)] = (n, counts[key])
        counts.update(now)
        times = [r[4] for r in batch if r[4] is not None and FACES.get(r[2])]
        latest = max([t for t in [latest, *times] if t is not None], default=None)
    return counts, late, fixes, latest


def test_windows_with_late_reports(spark, tmp_path):
    rng = random.Random(4)
    batches = []
    for k in range(4):
        batch = []
        for i in range(120):
            # Mostly of its own hour, some hours late; the third batch counts nothing.
            at = START + datetime.timedelta(minutes=k * 90 + rng.uniform(0, 90) - (rng.uniform(0, 400) if i % 6 == 0 else 0))
            spot = 4 if k == 2 else rng.choice([1, 1, 1, 2, 3, 4, 9])
            batch.append((k * 1000 + i, 1, spot, rng.choice(["AVAILABLE", "OCCUPIED", None]), None if i % 17 == 0 else at))
        batches.append(batch)
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    faces = spark.createDataFrame([(s, f) for s, f in FACES.items() if f], "parking_spot_id long, blockface_id string")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        writer = blockfaces.blockface_writer(stream, faces, out, check, "30 minutes", "1 hour")
        writer.trigger(availableNow=True).start().awaitTermination()

    for batch in batches:
        # A restart for each file, so that batches come in this order.
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        run()
    counts, late, fixes, latest = plain(batches)
    assert late and any(before for _, before in fixes.values())

    def state():
        rows = blockfaces.blockface_windows(spark, out, "30 minutes", "1 hour").collect()
        assert all(r.closed == (r.window_start + datetime.timedelta(minutes=90) <= latest) for r in rows)
        assert any(r.closed for r in rows) and not all(r.closed for r in rows)
        return {(r.blockface_id, r.window_start, r.status): (r.reports, r.late_reports) for r in rows}

    def fixed(after=-1):
        return {
            (r.blockface_id, r.window_start, r.status, r.batch_id): (r.reports, r.reports_before)
            for r in blockfaces.corrections(spark, out, after).collect()
        }

    wanted = {k: (n, late[k]) for k, n in counts.items()}
    assert state() == wanted and fixed() == fixes
    assert fixed(1) == {k: v for k, v in fixes.items() if k[3] > 1}
    run()
    assert read_batches(spark, f"{out}/counts").select("batch_id").distinct().count() == 3 and state() == wanted


def test_declared_keys(spark):
    spots = spark.createDataFrame([(1,), (1,), (2,)], "id long")
    favorites = spark.createDataFrame([(1, 1, 5), (2, 1, 5), (3, 2, 5), (4, 1, 5)], "id long, user_id long, parking_spot_id long")
    rows = integrity.declared_key_report({"parking_spots": spots, "favorite_parking_spots": favorites}).collect()
    assert {(r.table_name, r.key_columns, r.duplicate_keys, r.worst_count) for r in rows} == {
        ("parking_spots", "id", 1, 2), ("favorite_parking_spots", "id", 0, 0), ("favorite_parking_spots", "user_id,parking_spot_id", 1, 3)
    }
    with pytest.raises(ValueError, match="no rules"):
        integrity.declared_key_report({"nothing": spots})
    with pytest.raises(ValueError, match="lacks key columns: parking_spot_id, user_id"):
        integrity.declared_key_report({"favorite_parking_spots": spots})
    assert all(rule.unique for rule in schemas.RULES.values())
