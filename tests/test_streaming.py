from __future__ import annotations

from pyspark.sql import functions as F

from curbspark.operators import changes, reports
from curbspark.sources.tables import append_events, read_batches, with_utc_time, write_batch
from curbspark.streaming import jobs
from tests.support import spark_rows
from tests.test_state import FEED, random_feed, when


def split_files(df, path, parts):
    """One file per part, so that a stream takes several batches."""
    for i in range(parts):
        df.where(F.col("seq") % parts == i).coalesce(1).write.mode("append").parquet(path)


def test_change_stream_equals_batch(spark, tmp_path):
    table = spark.createDataFrame([(k, f"old{k}") for k in range(30)], "id long, status string")
    feed = spark.createDataFrame(random_feed(4), FEED)
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    split_files(feed, source, 4)

    def run():
        stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = jobs.change_feed_writer(stream, out, check).trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    batches = read_batches(spark, out).select("batch_id").distinct().count()
    assert batches == 4
    wanted = spark_rows(changes.apply_changes(table, feed))
    assert spark_rows(jobs.current_spots(spark, table, out)) == wanted
    # A restart finds nothing new; a replayed batch replaces itself.
    run()
    replayed = read_batches(spark, out).where("batch_id = 2").drop("batch_id")
    replayed.write.parquet(str(tmp_path / "copy"))
    write_batch(spark.read.parquet(str(tmp_path / "copy")), out, 2)
    assert spark_rows(jobs.current_spots(spark, table, out)) == wanted
    # Batches overlap in time, so compacted changes must still merge with later ones.
    compacted = str(tmp_path / "compacted")
    jobs.compact_changes(spark, out, compacted, upto=1)
    assert spark_rows(jobs.current_spots(spark, table, out, compacted=compacted, after=1)) == wanted


def test_report_stream_equals_batch(spark, tmp_path):
    spots = spark.createDataFrame([(k, "UNKNOWN", when(0)) for k in range(10)], "id long, status string, updated_at timestamp_ntz")
    rows = [
        (i, None if i % 9 == 0 else i, i * 7 % 12, ["AVAILABLE", "OCCUPIED", "TAKEN"][i % 3], when(i * 5 % 17)) for i in range(60)
    ]
    log = spark.createDataFrame(rows, "id long, user_id long, parking_spot_id long, status string, created_at timestamp_ntz")
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    split_files(log.withColumn("seq", F.col("id")), source, 3)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source)
    jobs.report_writer(stream, out, check).trigger(availableNow=True).start().awaitTermination()
    wanted, _, _ = reports.submit_reports(spots, log)
    assert spark_rows(jobs.spots_with_reports(spark, spots, out)) == spark_rows(wanted)
    now = F.lit("2024-01-18").cast("timestamp_ntz")
    fresh = reports.fresh_status(spots, log, now, 3 * 24 * 60)
    assert spark_rows(jobs.fresh_spots(spark, spots, out, now, 3 * 24 * 60)) == spark_rows(fresh)


def test_message_stream(spark, tmp_path):
    spots = spark.createDataFrame([(1, "x")], "id long, address string")
    ops = spark.createDataFrame([(1, "UPDATE", 0), (2, "DELETE", 1)], "id long, update_type string, seq int")
    split_files(ops, str(tmp_path / "in"), 2)
    stream = spark.readStream.schema(ops.schema).parquet(str(tmp_path / "in"))
    query = (
        jobs.message_stream(stream, spots).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert spark_rows(got) == spark_rows(changes.update_messages(ops, spots))


def test_event_stream(spark, tmp_path):
    events = spark.createDataFrame(
        [(i, f'{{"a":{i},"n":{{}}}}', when(i % 3), i) for i in range(6)], "id long, event_payload string, created_at timestamp_ntz, seq int"
    )
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    split_files(events, source, 2)
    for _ in range(2):
        stream = spark.readStream.schema(events.schema).parquet(source)
        jobs.event_writer(stream, out, check).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out).orderBy("id").collect()
    assert [r.event_payload for r in rows] == [f'{{"a":{i}}}' for i in range(6)]


def test_append_never_raises(spark, tmp_path):
    events = spark.createDataFrame([(1, when(0))], "id long, created_at timestamp_ntz")
    assert append_events(events, str(tmp_path / "log")) is True
    (tmp_path / "file").write_text("in the way")
    assert append_events(events, str(tmp_path / "file" / "log")) is False


def test_utc_time(spark):
    df = spark.createDataFrame([(when(0),)], "t timestamp_ntz")
    typed = with_utc_time(df)
    assert typed.schema["t"].dataType.simpleString() == "timestamp"
    assert typed.select(F.unix_seconds("t").alias("s")).collect()[0].s == 1704067200
