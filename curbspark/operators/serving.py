"""Spot lists as clients ask for them: boxes, circles, top-k, search, chips."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbspark.functions import display, geo

# Default sizes of lists and searches.
LATEST_LIMIT = 10
BOX_LIMIT = 100
FALLBACK_LIMIT = 50
NEARBY_LIMIT = 100
LIST_LIMIT = 500
FIRST_SPOTS = 6
SEARCH_RADIUS_METERS = 2000
CHIPS = {
    "AVAILABLE": ("status", "AVAILABLE"),
    "OCCUPIED": ("status", "OCCUPIED"),
    "METERED": ("parking_type", "METERED"),
    "FREE": ("parking_type", "FREE"),
}


def latest_spots(spots: DataFrame, limit: int = LATEST_LIMIT, key: str = "id") -> DataFrame:
    return spots.orderBy(F.desc("updated_at"), F.asc(key)).limit(limit)


def in_box(df: DataFrame, lat: float, lng: float, radius_meters: float) -> DataFrame:
    offset = geo.degrees_offset(radius_meters)
    return df.where(geo.in_box(F.col("latitude"), F.col("longitude"), lat, lng, offset))


def spots_in_box(
    spots: DataFrame,
    lat: float,
    lng: float,
    radius_meters: float = SEARCH_RADIUS_METERS,
    limit: int = BOX_LIMIT,
    key: str = "id",
) -> DataFrame:
    """Most recently updated spots of a box around a point."""
    return latest_spots(in_box(spots, lat, lng, radius_meters), limit, key)


def spots_with_fallback(
    spots: DataFrame, lat: float, lng: float, radius_meters: float = SEARCH_RADIUS_METERS, key: str = "id"
) -> DataFrame:
    """Spots of the box, or the latest of all when the box is empty.

    `is_fallback` tells which.  The gate is an anti join against at most one
    row; once that row exists adaptive execution drops the second scan.
    """
    near = spots_in_box(spots, lat, lng, radius_meters, key=key)
    any_near = in_box(spots, lat, lng, radius_meters).select(F.lit(1).alias("_hit")).limit(1)
    gated = spots.join(F.broadcast(any_near), how="left_anti")
    latest = latest_spots(gated, FALLBACK_LIMIT, key)
    return near.withColumn("is_fallback", F.lit(False)).unionByName(
        latest.withColumn("is_fallback", F.lit(True))
    )


def check_point(lat: float, lng: float) -> None:
    if not geo.is_point(lat, lng):
        raise ValueError("invalid latitude or longitude")


def check_radius(radius: float) -> None:
    if not (math.isfinite(radius) and radius > 0):
        raise ValueError("radius must be a positive number")


def within_radius(
    df: DataFrame, lat: float, lng: float, radius_miles: float, clip_box: bool = True
) -> DataFrame:
    """Rows within a great-circle distance, with `distance_miles`.

    With `clip_box` rows must also lie in the degree box of the same radius,
    which is narrower than the circle away from the equator; without it the
    box covers the circle and only cuts the scan.
    """
    check_point(lat, lng)
    check_radius(radius_miles)
    latitude, longitude = F.col("latitude"), F.col("longitude")
    if clip_box:
        offset = geo.degrees_offset(radius_miles * geo.METERS_PER_MILE)
        box = geo.in_box(latitude, longitude, lat, lng, offset)
    else:
        box = geo.covering_box(latitude, longitude, lat, lng, radius_miles)
    distance = geo.haversine_miles(F.lit(lat), F.lit(lng), latitude, longitude)
    return df.where(box).withColumn("distance_miles", distance).where(F.col("distance_miles") <= radius_miles)


def nearest(
    df: DataFrame,
    lat: float,
    lng: float,
    radius_miles: float,
    limit: int = NEARBY_LIMIT,
    clip_box: bool = True,
    key: str = "id",
) -> DataFrame:
    """The k nearest rows within a radius, nearest first."""
    found = within_radius(df, lat, lng, radius_miles, clip_box)
    return found.orderBy("distance_miles", key).limit(max(1, limit))


def radius_leaks(found: DataFrame, radius_miles: float) -> DataFrame:
    """Number of rows beyond the radius they were searched with; must be 0."""
    return found.agg(F.count_if(F.col("distance_miles") > radius_miles + 1e-6).alias("leaks"))


def available_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("available"))


def newest_in_city(
    locations: DataFrame, city: str, limit: int = LIST_LIMIT, key: str = "source_id"
) -> DataFrame:
    """Newest synced rows of a city; case is ignored and `%` and `_` are wildcards."""
    wanted = city.strip()
    if not wanted:
        raise ValueError("city is required")
    return _newest(locations.where(F.col("city").ilike(wanted)), limit, key)


def newest_active(locations: DataFrame, limit: int = LIST_LIMIT, key: str = "source_id") -> DataFrame:
    return _newest(locations.where(F.col("active")), limit, key)


def _newest(df: DataFrame, limit: int, key: str) -> DataFrame:
    return df.orderBy(F.desc("last_synced_at"), F.asc(key)).limit(max(1, limit))


def typed_location(locations: DataFrame) -> DataFrame:
    """Location rows with the types clients rely on; no provenance gives `{}`."""
    raw = F.col("raw_source").cast("string")
    return locations.select(
        *[F.col(c).cast("string") for c in ("source_type", "source_id")],
        *[F.col(c).cast("double") for c in ("latitude", "longitude")],
        *[F.col(c).cast("string") for c in ("address", "parking_type", "time_limit")],
        F.coalesce(F.col("active").cast("boolean"), F.lit(False)).alias("active"),
        *[F.col(c).cast("string") for c in ("restrictions", "city")],
        F.when(F.json_object_keys(raw).isNotNull(), raw).otherwise("{}").alias("raw_source"),
        "last_synced_at",
    )


def by_chip(spots: DataFrame, chip: str, favorites: DataFrame | None = None) -> DataFrame:
    """Spots of one filter chip; FAVORITES takes the caller's favorite rows."""
    if chip == "ALL":
        return spots
    if chip == "FAVORITES":
        if favorites is None:
            return spots.where(F.lit(False))
        return favorite_spots(spots, favorites)
    column, value = CHIPS[chip]
    return spots.where(F.col(column) == value)


def _has_text(column: Column, query: str) -> Column:
    return F.coalesce(F.lower(column).contains(query.lower()), F.lit(False))


def search_text(spots: DataFrame, query: str) -> DataFrame:
    """Case-insensitive substring of street or address; a blank query keeps all."""
    if not query.strip():
        return spots
    return spots.where(_has_text(F.col("street_name"), query) | _has_text(F.col("address"), query))


def search_address(spots: DataFrame, query: str, available: bool = False) -> DataFrame:
    found = spots.where(_has_text(F.col("address"), query))
    return available_only(found) if available else found


def missing_location(clean_meters: DataFrame) -> DataFrame:
    return clean_meters.where(F.col("location_description").isNull())


def own_rows(df: DataFrame, user_id, column: str = "user_id") -> DataFrame:
    """Rows of one user; nobody signed in sees nothing."""
    return df.where(F.lit(False) if user_id is None else F.col(column) == user_id)


def by_id(df: DataFrame, key_value, key: str = "id") -> DataFrame:
    """The one row of an id; reading it fails when there is none.

    The fallback row of the union exists only when the id is absent.
    """
    found = df.where(F.col(key) == key_value)
    missing = found.agg(F.count(F.lit(1)).alias("_n")).where(
        F.when(F.col("_n") == 0, F.raise_error(F.lit(f"no row with {key} = {key_value}")).cast("boolean"))
        .otherwise(F.lit(False))
    )
    absent = missing.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    return found.unionByName(absent)


def event_rights(events: DataFrame, caller_id) -> DataFrame:
    """Events with `allowed`: callers insert for themselves or for nobody."""
    own = F.lit(False) if caller_id is None else F.coalesce(F.col("user_id") == caller_id, F.lit(False))
    return events.withColumn("allowed", F.col("user_id").isNull() | own)


def insert_rights(rows: DataFrame, caller_id) -> DataFrame:
    """Reports or favorites with `allowed`: only for the caller's own id."""
    own = F.lit(False) if caller_id is None else F.coalesce(F.col("user_id") == caller_id, F.lit(False))
    return rows.withColumn("allowed", own)


def favorite_spots(spots: DataFrame, favorites: DataFrame, key: str = "id") -> DataFrame:
    """Spots that are among the given favorites."""
    ids = favorites.select(F.col("parking_spot_id").alias(key)).distinct()
    return spots.join(ids, key, "left_semi")


def spot_cards(spots: DataFrame, now: Column) -> DataFrame:
    """Spots with their display columns."""
    return spots.select(
        "*",
        display.status_label(F.col("status")).alias("status_label"),
        display.type_label(F.col("parking_type")).alias("type_label"),
        display.marker_color(F.col("status")).alias("marker_color"),
        display.pin_color(F.col("status")).alias("pin_color"),
        display.display_price(F.col("price")).alias("display_price"),
        display.updated_label(F.col("updated_at"), now).alias("updated_label"),
        display.time_ago(F.col("updated_at"), now).alias("time_ago"),
    )


def first_nearby(
    spots: DataFrame,
    lat: float,
    lng: float,
    radius_meters: float = SEARCH_RADIUS_METERS,
    limit: int = FIRST_SPOTS,
    key: str = "id",
) -> DataFrame:
    """First spots of a circle in key order, for a dashboard."""
    found = within_radius(spots, lat, lng, radius_meters / geo.METERS_PER_MILE, clip_box=False)
    return found.orderBy(key).limit(limit)


def first_available(spots: DataFrame, limit: int = FIRST_SPOTS, key: str = "id") -> DataFrame:
    """First available spots in key order, for when there is no nearby search."""
    return available_only(spots).orderBy(key).limit(limit)
