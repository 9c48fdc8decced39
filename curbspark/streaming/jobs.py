"""Change, report and event streams.

Sinks write one folder per micro-batch under the batch id, so a batch that is
replayed after a failure replaces its own output.  Each folder holds only what
its batch changed, reduced to one row per key; reading combines the folders.
The cost of a batch thus follows the batch and not the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from curbspark.functions.payload import sanitize_payload
from curbspark.operators.changes import apply_fold, fold_changes, merge_folds, update_messages
from curbspark.operators.latest import latest_per_key
from curbspark.operators.reports import REJECT, check_reports, fresh_status, latest_status, set_status
from curbspark.sources.tables import read_batches, write_batch


def _writer(stream: DataFrame, name: str, checkpoint: str) -> DataStreamWriter:
    return stream.writeStream.queryName(name).option("checkpointLocation", checkpoint)


def change_feed_writer(
    feed: DataFrame, out: str, checkpoint: str, key: str = "id", order: tuple[str, ...] = ("ts", "seq")
) -> DataStreamWriter:
    """Stream of row changes to folded batches; start it with the wanted trigger."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        write_batch(fold_changes(batch, key, order), out, batch_id)

    return _writer(feed, "change_feed", checkpoint).foreachBatch(sink)


def current_spots(
    spark: SparkSession, snapshot: DataFrame, out: str, key: str = "id", compacted: str | None = None, after: int = -1
) -> DataFrame:
    """Snapshot plus every folded batch, or plus a compacted fold and the batches after it."""
    folds = read_batches(spark, out, after).drop("batch_id")
    if compacted:
        folds = spark.read.parquet(compacted).unionByName(folds)
    return apply_fold(snapshot, merge_folds(folds, key), key)


def compact_changes(spark: SparkSession, out: str, target: str, upto: int, key: str = "id") -> None:
    """Write the folds of all batches up to `upto` as one, for `current_spots`.

    It stays a fold, with positions, and is not applied to the snapshot: a
    change that arrives late can still fall before ones already compacted.
    A failed run leaves no success marker and is simply repeated.
    """
    done = read_batches(spark, out).where(F.col("batch_id") <= upto).drop("batch_id")
    merge_folds(done, key).write.mode("overwrite").parquet(target)


def report_writer(
    reports: DataFrame, out: str, checkpoint: str, *, spots: DataFrame | None = None, checked: str | None = None
) -> DataStreamWriter:
    """Stream of reports to the latest well-formed report per spot and batch.

    With `spots` and `checked`, every report is stored in the folder `checked`
    too, with the reason why it is refused or null; both outputs of a batch are
    replaced when it is replayed.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        if checked is not None:
            write_batch(check_reports(batch, spots), checked, batch_id)
        write_batch(latest_status(batch), out, batch_id)

    return _writer(reports, "reports", checkpoint).foreachBatch(sink)


def stored_reports(spark: SparkSession, checked: str) -> tuple[DataFrame, DataFrame]:
    """(accepted reports, rejected reports with their reason) of all batches."""
    rows = read_batches(spark, checked).drop("batch_id")
    accepted = rows.where(F.col(REJECT).isNull()).drop(REJECT)
    return accepted, rows.where(F.col(REJECT).isNotNull())


def spots_with_reports(
    spark: SparkSession, spots: DataFrame, out: str, at: Column | None = None, after: int = -1
) -> DataFrame:
    """Spots with the status of all report batches later than `after`."""
    batches = read_batches(spark, out, after).drop("batch_id")
    return set_status(spots, latest_per_key(batches, ["parking_spot_id"], ["created_at", "id"]), at)


def fresh_spots(
    spark: SparkSession, spots: DataFrame, out: str, now: Column, ttl_minutes: int = 20, after: int = -1
) -> DataFrame:
    """Spots with the status of reports young enough at `now`, else UNKNOWN.

    Decay depends on the latest report and the clock alone, so it is worked
    out when read; the stream needs no timers.  `now` must not lie before the
    reports already taken in, as a batch keeps only the latest one per spot;
    for a moment in the past use `fresh_status` over the report table.
    """
    batches = read_batches(spark, out, after).drop("batch_id").withColumn("user_id", F.lit(0))
    return fresh_status(spots, batches, now, ttl_minutes)


def message_stream(operations: DataFrame, spots: DataFrame, key: str = "id") -> DataFrame:
    """Stream of typed update messages, each with its spot."""
    return update_messages(operations, spots, key)


def clean_events(events: DataFrame) -> DataFrame:
    """Events with sanitized payload and the day they are stored under."""
    return events.withColumns(
        {"event_payload": sanitize_payload(F.col("event_payload")), "event_date": F.to_date("created_at")}
    )


def event_writer(events: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    """Stream of events to the append-only log, by day, exactly once."""
    return (
        _writer(clean_events(events), "events", checkpoint)
        .format("parquet")
        .option("path", out)
        .partitionBy("event_date")
        .outputMode("append")
    )
