"""Reports per blockface and time window as a stream, with a watermark and corrections.

Each micro-batch is reduced to one row per blockface, window and status. Its
watermark is the latest report time of all batches before it, less the delay that
reports are granted: a window that ends at or before the watermark is closed. Reports
that still arrive for a closed window are not dropped, but counted apart as its
correction. Counts add up across batches, and a replayed batch replaces its own
folder and reaches the same verdicts, as it looks at earlier batches only.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from curbspark.operators.reports import reports_per_blockface
from curbspark.sources.tables import read_batches, write_batch

_KEYS = ("blockface_id", "window_start", "status")


def _closed(window_start: Column, window: str, delay: str, latest: Column) -> Column:
    """Whether the window's end plus the granted delay has been reached; nothing is closed before the first report."""
    end = window_start + F.expr(f"interval {window}") + F.expr(f"interval {delay}")
    return F.coalesce(end <= latest, F.lit(False))


def _latest(spark: SparkSession, out: str, before: int | None = None) -> datetime | None:
    """Latest report time of the batches, from one row a batch."""
    if before == 0:
        return None
    marks = read_batches(spark, f"{out}/marks")
    earlier = marks if before is None else marks.where(F.col("batch_id") < before)
    return earlier.agg(F.max("latest").alias("latest")).first().latest


def blockface_writer(
    reports: DataFrame, faces: DataFrame, out: str, checkpoint: str, window: str = "30 minutes", delay: str = "2 hours"
) -> DataStreamWriter:
    """Stream of reports to window counts under `out`; start it with the wanted trigger.

    `faces` maps parking_spot_id to blockface_id.  Reports without a time or on
    spots without a blockface are not counted.  The watermark follows reports
    that were counted.
    """
    out = out.rstrip("/")

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        counted = reports_per_blockface(batch, faces, window)
        kind = counted.schema["window_start"].dataType
        before = F.lit(_latest(spark, out, batch_id)).cast(kind)
        write_batch(counted.withColumn("late", _closed(F.col("window_start"), window, delay, before)), f"{out}/counts", batch_id)
        # From the rows just written, so that the batch is read once.
        written = spark.read.parquet(f"{out}/counts/batch_id={batch_id}")
        write_batch(written.agg(F.max("last_report_at").alias("latest")), f"{out}/marks", batch_id)

    return reports.writeStream.queryName("blockfaces").option("checkpointLocation", checkpoint).foreachBatch(sink)


def blockface_windows(spark: SparkSession, out: str, window: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """Per blockface, window and status: all `reports`, `late_reports` among them, `last_report_at`, and
    whether the window is `closed` by now."""
    out = out.rstrip("/")
    rows = read_batches(spark, f"{out}/counts")
    latest = F.lit(_latest(spark, out)).cast(rows.schema["window_start"].dataType)
    late = F.when(F.col("late"), F.col("reports")).otherwise(0)
    return (
        rows.groupBy(*_KEYS)
        .agg(F.sum("reports").alias("reports"), F.sum(late).alias("late_reports"), F.max("last_report_at").alias("last_report_at"))
        .withColumn("closed", _closed(F.col("window_start"), window, delay, latest))
    )


def corrections(spark: SparkSession, out: str, after: int = -1) -> DataFrame:
    """What batches later than `after` add to windows that were closed before: the key, `batch_id`,
    `reports` to add, and `reports_before` them.

    A reader that has published closed windows brings them up to date from these rows alone.
    """
    rows = read_batches(spark, f"{out.rstrip('/')}/counts")
    # A window has one row a batch that touched it, however many its reports are.
    before = Window.partitionBy(*_KEYS).orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("reports_before", F.coalesce(F.sum("reports").over(before), F.lit(0)))
    return summed.where(F.col("late") & (F.col("batch_id") > after)).select(*_KEYS, "batch_id", "reports", "reports_before")
