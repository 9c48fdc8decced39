"""Table reads and the batch-folder layout of streaming sinks."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet table with an explicit column list."""
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def write_located(df: DataFrame, path: str, key: str = "id", cell_degrees: float = 0.01) -> None:
    """Write a table with coordinates so that box searches skip most files.

    Rows are range-partitioned and sorted by grid cell, which makes the
    latitude and longitude bounds of files and row groups narrow.  The key
    ends the order, so a cell of any size can be split.
    """
    row, column = F.floor(F.col("latitude") / cell_degrees), F.floor(F.col("longitude") / cell_degrees)
    (
        df.repartitionByRange(row, column, F.col(key))
        .sortWithinPartitions(row, column, F.col(key))
        .write.mode("overwrite")
        .parquet(path)
    )


def with_utc_time(table: DataFrame) -> DataFrame:
    """Timestamps without zone read as UTC instants, as streams and watermarks need."""
    casts = {
        f.name: F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(f.name)).cast("timestamp")
        for f in table.schema.fields
        if isinstance(f.dataType, T.TimestampNTZType)
    }
    return table.withColumns(casts)


def append_events(events: DataFrame, path: str) -> bool:
    """Append to the event log by day; a failure is logged and never raised.

    The rebalance hint gathers a day's rows into few files and splits a day
    that is too large for one task.
    """
    try:
        (
            events.withColumn("event_date", F.to_date("created_at"))
            .hint("rebalance", "event_date")
            .write.mode("append")
            .partitionBy("event_date")
            .parquet(path)
        )
        return True
    except Exception:
        log.exception("event append to %s failed", path)
        return False


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """One folder per micro-batch; a replayed batch replaces its own folder."""
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str, after: int = -1) -> DataFrame:
    """All micro-batches later than `after`, with their `batch_id`."""
    return spark.read.parquet(path).where(F.col("batch_id") > after)
