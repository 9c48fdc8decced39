"""User reports: checks, guarded status updates, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbspark.operators.latest import latest_per_key
from curbspark.operators.skew import lookup_join, unique_join
from curbspark.schemas import STATUSES

REJECT = "reject_reason"
ORDER = ("created_at", "id")


def _input_problem() -> Column:
    return F.when(F.col("user_id").isNull(), "not_authenticated").when(
        ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "invalid_status"
    )


def check_reports(reports: DataFrame, spots: DataFrame, **join_options) -> DataFrame:
    """Reports with `reject_reason`: no user, then bad status, then no such spot.

    One spot may draw a third of all reports, hence the lookup join.
    """
    known = spots.select(F.col("id").alias("parking_spot_id"), F.lit(True).alias("_known"))
    joined = lookup_join(reports, known, ["parking_spot_id"], "left", salt_by=["id"], **join_options)
    unknown = F.when(F.col("_known").isNull(), "spot_not_found")
    return joined.withColumn(REJECT, F.coalesce(_input_problem(), unknown)).select(*reports.columns, REJECT)


def latest_status(reports: DataFrame) -> DataFrame:
    """Latest well-formed report per spot: parking_spot_id, status, created_at, id."""
    usable = reports.where(_input_problem().isNull()).select("parking_spot_id", "status", *ORDER)
    return latest_per_key(usable, ["parking_spot_id"], list(ORDER))


def set_status(spots: DataFrame, latest: DataFrame, at: Column | None = None, **join_options) -> DataFrame:
    """Spots after status changes, one per spot in `latest`.

    Only status changes; `updated_at` becomes `at`, or the report's time when
    reports are applied the moment they arrive.  Reports on spots that do not
    exist fall away in the join.
    """
    news = latest.select(
        F.col("parking_spot_id").alias("id"),
        F.col("status").alias("_status"),
        (F.col("created_at") if at is None else at).alias("_at"),
    )
    touched = F.col("_status").isNotNull()
    changed = {"status": F.col("_status"), "updated_at": F.col("_at")}
    return unique_join(spots, news, ["id"], **join_options).select(
        *[
            F.when(touched, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c)
            for c in spots.columns
        ]
    )


def submit_reports(
    spots: DataFrame, reports: DataFrame, at: Column | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spots after the reports, reports to append, rejected reports)."""
    checked = check_reports(reports, spots)
    accepted = checked.where(F.col(REJECT).isNull()).drop(REJECT)
    rejected = checked.where(F.col(REJECT).isNotNull())
    return set_status(spots, latest_status(reports), at), accepted, rejected


def fresh_status(
    spots: DataFrame, reports: DataFrame, now: Column, ttl_minutes: int = 20, **join_options
) -> DataFrame:
    """Status as of `now`: the latest report if young enough, else UNKNOWN.

    Reports later than `now` do not count yet.  Adds `reported_at`, the time
    of the report behind the status.
    """
    since = now - F.make_interval(mins=F.lit(ttl_minutes))
    valid = reports.where((F.col("created_at") <= now) & (F.col("created_at") >= since))
    news = latest_status(valid).select(
        F.col("parking_spot_id").alias("id"), F.col("status").alias("_status"), F.col("created_at").alias("reported_at")
    )
    status = F.coalesce(F.col("_status"), F.lit("UNKNOWN")).alias("status")
    return unique_join(spots, news, ["id"], **join_options).select(
        *[status if c == "status" else F.col(c) for c in spots.columns], "reported_at"
    )


def reports_per_blockface(
    reports: DataFrame, spot_blockfaces: DataFrame, window: str = "30 minutes", **join_options
) -> DataFrame:
    """Report counts per blockface, time window and status.

    `spot_blockfaces` maps parking_spot_id to blockface_id.  Reports are
    counted per spot first, so the join sees one row per spot and window.
    """
    per_spot = reports.groupBy("parking_spot_id", F.window("created_at", window).alias("_w"), "status").agg(
        F.count(F.lit(1)).alias("_n"), F.max("created_at").alias("_last")
    )
    placed = lookup_join(
        per_spot, spot_blockfaces, ["parking_spot_id"], "inner", salt_by=["_w", "status"], **join_options
    )
    return placed.groupBy(
        "blockface_id", F.col("_w.start").alias("window_start"), F.col("status")
    ).agg(F.sum("_n").alias("reports"), F.max("_last").alias("last_report_at"))
