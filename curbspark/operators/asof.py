"""Status at many moments: each probe takes the last report before it.

Reports and probes are put into one order per spot and a window carries the last
report on. Time is cut into slices, so that a spot with any number of reports is
many small groups: a slice knows its own last report, and what holds at the start of
a slice follows from one row a slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbspark.schemas import STATUSES

#: Seconds of a slice.
SLICE_SECONDS = 86_400
UNKNOWN = "UNKNOWN"


def _slice(at: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(at.cast("timestamp")) / (seconds * 1_000_000))


def status_as_of(
    reports: DataFrame, probes: DataFrame, ttl: Column | None = None, *, slice_seconds: int = SLICE_SECONDS
) -> DataFrame:
    """probes (parking_spot_id, at and any others) with status and reported_at of the last report up to `at`.

    Of reports at one moment the greater id counts last. A report at the moment of
    the probe counts. With `ttl` (an interval) older reports do not hold, and without
    any report the status is UNKNOWN. Reports with an unknown status, without a spot
    or without a time count for nothing; a probe without spot or time is UNKNOWN.
    Repeated probes give a row each.
    """
    others = [c for c in probes.columns if c not in ("parking_spot_id", "at")]
    known = reports.where(F.col("status").isin(*STATUSES) & F.col("parking_spot_id").isNotNull() & F.col("created_at").isNotNull())
    events = known.select(
        "parking_spot_id",
        _slice(F.col("created_at"), slice_seconds).alias("_slice"),
        F.col("created_at").alias("_at"),
        F.lit(0).alias("_probe"),
        F.col("id").alias("_id"),
        F.struct("status", F.col("created_at").alias("reported_at")).alias("_report"),
    )
    asked = probes.where(F.col("parking_spot_id").isNotNull() & F.col("at").isNotNull()).select(
        "parking_spot_id",
        _slice(F.col("at"), slice_seconds).alias("_slice"),
        F.col("at").alias("_at"),
        F.lit(1).alias("_probe"),
        F.struct(*others, F.lit(True).alias("_is_probe")).alias("_other"),
    )
    both = events.unionByName(asked, allowMissingColumns=True)
    order = Window.partitionBy("parking_spot_id", "_slice").orderBy("_at", "_probe", "_id")
    carried = both.withColumn("_last", F.last("_report", ignorenulls=True).over(order))
    # One row a spot and slice: its last report, then the last one of the slices before it.
    ends = both.groupBy("parking_spot_id", "_slice").agg(
        F.max(F.when(F.col("_probe") == 0, F.struct("_at", "_id", "_report"))).alias("_end"),
        F.max("_probe").alias("_asked"),
    )
    slices = Window.partitionBy("parking_spot_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ends.withColumn("_start", F.last("_end", ignorenulls=True).over(slices))
        .where("_asked = 1 AND _start IS NOT NULL")
        .select("parking_spot_id", "_slice", F.col("_start._report").alias("_before"))
    )
    answered = (
        carried.where("_probe = 1")
        .join(starts, ["parking_spot_id", "_slice"], "left")
        .select("parking_spot_id", F.col("_at").alias("at"), "_other", F.coalesce("_last", "_before").alias("_report"))
    )
    nowhere = probes.where(F.col("parking_spot_id").isNull() | F.col("at").isNull())
    rows = answered.select(
        "parking_spot_id", "at", *(F.col(f"_other.{c}").alias(c) for c in others), "_report"
    ).unionByName(nowhere, allowMissingColumns=True)
    holds = F.col("_report").isNotNull()
    if ttl is not None:
        holds = holds & (F.col("_report.reported_at") >= F.col("at") - ttl)
    return rows.select(
        *probes.columns,
        F.when(holds, F.col("_report.status")).otherwise(UNKNOWN).alias("status"),
        F.when(holds, F.col("_report.reported_at")).alias("reported_at"),
    )
