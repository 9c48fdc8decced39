"""Favorite pairs folded from an add/remove log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbspark.operators.skew import lookup_join

PAIR = ["user_id", "parking_spot_id"]


def current_favorites(favorite_log: DataFrame, **join_options) -> DataFrame:
    """Pairs that exist after the log: user_id, parking_spot_id, created_at, seq.

    The log has op `add` or `remove` and is ordered by (ts, seq).  Adding a
    pair that exists changes nothing, so a pair dates from the first add after
    its last remove.  Both steps are aggregates that combine on the map side.
    """
    position = F.struct("ts", "seq")
    removed = (
        favorite_log.where(F.col("op") == "remove").groupBy(*PAIR).agg(F.max(position).alias("_removed"))
    )
    adds = favorite_log.where(F.col("op") == "add").select(*PAIR, position.alias("_added"))
    last = lookup_join(adds, removed, PAIR, "left", salt_by=["_added"], **join_options)
    standing = last.where(F.col("_removed").isNull() | (F.col("_added") > F.col("_removed")))
    return (
        standing.groupBy(*PAIR)
        .agg(F.min("_added").alias("_at"))
        .select(*PAIR, F.col("_at.ts").alias("created_at"), F.col("_at.seq").alias("seq"))
    )


def favorites_of(favorites: DataFrame, user_id) -> DataFrame:
    """One user's favorites, newest first."""
    mine = favorites.where(F.lit(False) if user_id is None else F.col("user_id") == user_id)
    return mine.orderBy(F.desc("created_at"), F.asc("parking_spot_id"))


def is_favorite(favorites: DataFrame, user_id, spot_id) -> DataFrame:
    """One row, `is_favorite`."""
    hit = (F.col("user_id") == user_id) & (F.col("parking_spot_id") == spot_id)
    return favorites.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("is_favorite"))


def toggles(favorites: DataFrame, requests: DataFrame) -> DataFrame:
    """Toggle requests (user_id, parking_spot_id, ts, seq) as log rows with `op`.

    Requests of a pair alternate between adding and removing, starting from
    whether the pair exists, so their number decides the outcome: an existing
    pair goes at its first request, and a pair that ends up present dates from
    its last one.
    """
    position = F.struct("ts", "seq")
    wanted = requests.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("_n"), F.min(position).alias("_first"), F.max(position).alias("_last")
    )
    exists = favorites.select(*PAIR, F.lit(True).alias("_exists"))
    held = wanted.join(exists, PAIR, "left").withColumn("_held", F.coalesce("_exists", F.lit(False)))
    ends_present = F.col("_held") == (F.col("_n") % 2 == 0)

    def entry(op: str, place: str) -> Column:
        return F.struct(F.lit(op).alias("op"), F.col(place)["ts"].alias("ts"), F.col(place)["seq"].alias("seq"))

    entries = F.array_compact(
        F.array(F.when(F.col("_held"), entry("remove", "_first")), F.when(ends_present, entry("add", "_last")))
    )
    return held.select(*PAIR, F.inline(entries))


def favorites_with_spot(favorites: DataFrame, spots: DataFrame, **join_options) -> DataFrame:
    """Favorites with their spot embedded as a struct; popular spots are salted."""
    embedded = spots.select(
        F.col("id").alias("parking_spot_id"), F.struct(*spots.columns).alias("parking_spot")
    )
    return lookup_join(
        favorites, embedded, ["parking_spot_id"], "inner", salt_by=["user_id"], **join_options
    )
