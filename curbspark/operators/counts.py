"""Counts: per user, per event, dashboards and import counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def user_activity(favorites: DataFrame, reports: DataFrame) -> DataFrame:
    """Favorites and reports per user, 0 where a user has none.

    Each side is counted before the join, so both hold a user once.
    """

    def per_user(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.count(F.lit(1)).alias(name))

    both = per_user(favorites, "favorites").join(per_user(reports, "reports"), "user_id", "full")
    return both.select(
        "user_id",
        F.coalesce("favorites", F.lit(0)).alias("favorites"),
        F.coalesce("reports", F.lit(0)).alias("reports"),
    )


def count_for_user(df: DataFrame, user_id) -> DataFrame:
    """One row: how many rows a user has; 0 when nobody is signed in."""
    mine = F.lit(False) if user_id is None else F.col("user_id") == user_id
    return df.agg(F.count_if(mine).alias("row_count"))


def dashboard_stats(spots: DataFrame, favorites_of_user: DataFrame) -> DataFrame:
    """Total and available spots, the user's favorites; searches are not recorded.

    The two one-row aggregates meet by union and a last sum, not by a join.
    """
    empty = F.lit(0).cast("bigint")
    of_spots = spots.agg(
        F.count(F.lit(1)).alias("total_spots"), F.count_if("available").alias("available_spots")
    ).withColumn("favorite_spots", empty)
    of_user = favorites_of_user.agg(F.count(F.lit(1)).alias("favorite_spots")).select(
        empty.alias("total_spots"), empty.alias("available_spots"), "favorite_spots"
    )
    return of_spots.unionByName(of_user).agg(
        *[F.sum(c).alias(c) for c in ("total_spots", "available_spots", "favorite_spots")],
        F.lit(0).cast("bigint").alias("recent_searches"),
    )


def distinct_favorites(favorites: DataFrame) -> DataFrame:
    return favorites.select("parking_spot_id").distinct()


def event_rollup(events: DataFrame, approximate: bool = False) -> DataFrame:
    """Events, identified events and users per event name and day.

    Exact user counts first reduce to one row per name, day and user on the
    map side; the sketch variant needs a single exchange of small sketches.
    """
    by = ["event_name", "event_date"]
    dated = events.select("event_name", F.to_date("created_at").alias("event_date"), "user_id")
    if approximate:
        return dated.groupBy(*by).agg(
            F.count(F.lit(1)).alias("events"),
            F.count("user_id").alias("identified_events"),
            F.approx_count_distinct("user_id").alias("users"),
        )
    per_user = dated.groupBy(*by, "user_id").agg(F.count(F.lit(1)).alias("_n"))
    return per_user.groupBy(*by).agg(
        F.sum("_n").alias("events"),
        F.coalesce(F.sum(F.when(F.col("user_id").isNotNull(), F.col("_n"))), F.lit(0)).alias("identified_events"),
        F.count("user_id").alias("users"),
    )


def skip_counts(mapped: DataFrame, reasons: tuple[str, ...], reason: Column | None = None) -> DataFrame:
    """Fetched, skipped, ready and one counter per reason, in one pass."""
    why = F.col("skip_reason") if reason is None else reason
    return mapped.agg(
        F.count(F.lit(1)).alias("fetched"),
        F.count(why).alias("skipped"),
        F.count_if(why.isNull()).alias("ready"),
        *[F.count_if(why == r).alias(f"skipped_{r}") for r in reasons],
    )
