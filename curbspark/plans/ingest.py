"""City feeds to typed block and meter tables.

Input feeds have columns `feed_pos`, which sorts in feed order, and `raw`, the
JSON text of one record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbspark.functions import feed_fields as names
from curbspark.functions.geo import valid_coordinate
from curbspark.functions.text import first_of, is_whole, number_fields, scalar_text, trimmed_fields
from curbspark.operators.latest import first_per_key, latest_per_key
from curbspark.operators.once import evaluate_once
from curbspark.operators.skew import lookup_join, unique_join

MISSING_COORDINATES = "missing_coordinates"
INVALID_COORDINATES = "invalid_coordinates"
MISSING_METER_ID = "missing_meter_id"
METER_SKIPS = (MISSING_COORDINATES, MISSING_METER_ID, INVALID_COORDINATES)
INVALID_SPACES = "invalid_spaces_count"
REGULATION = ("regulation_type", "agency", "days_of_week", "hours", "hour_limit", "permit_area")


def row_id(*parts: Column) -> Column:
    """Id derived from the natural key, the same on every run."""
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def parse_feed(feed: DataFrame, fields: tuple[str, ...], numbers: tuple[str, ...], keep: list[str]) -> DataFrame:
    """Kept feed columns, `text` with every field trimmed, `number` with those that are numbers.

    Also `pair`, the coordinates of the shape, and `location`, the nested point.
    """
    record = F.col("record")
    parsed = evaluate_once(feed, keep, record=names.parse_record(F.col("raw"), fields))
    return evaluate_once(
        parsed,
        keep,
        text=trimmed_fields("record", list(dict.fromkeys(fields))),
        number=number_fields("record", list(dict.fromkeys(numbers))),
        pair=record["shape"]["coordinates"],
        location=names.nested_location(record) if "location" in fields else F.lit(None),
    )


def parse_point(lat: Column, lng: Column, pair: Column, location: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a record before validation.

    Own fields first.  If either is missing, a two-item `shape.coordinates`
    replaces both; `location` then fills whichever is still missing.
    """
    use_pair = (lat.isNull() | lng.isNull()) & (F.size(pair) == 2)
    lat_or_pair = F.when(use_pair, F.get(pair, 1)).otherwise(lat)
    lng_or_pair = F.when(use_pair, F.get(pair, 0)).otherwise(lng)
    return F.coalesce(lat_or_pair, location["latitude"]), F.coalesce(lng_or_pair, location["longitude"])


def place_text() -> Column:
    """`number street`, else street, else neighborhood, else a free-text place."""
    text = F.col("text")
    street = first_of("text", names.STREET)
    return F.coalesce(
        F.concat(first_of("text", names.STREET_NUMBER), F.lit(" "), street),
        street,
        first_of("text", names.NEIGHBORHOOD),
        *[scalar_text(text[key]) for key in names.PLACE],
    )


def map_meters(feed: DataFrame, source_id: str, imported_at: Column) -> DataFrame:
    """Every feed row as a meter with `skip_reason`, null where it is usable.

    Bad coordinates are `invalid` only if a plain latitude or longitude field
    held a number; a bad x/y, shape or location counts as missing.
    """
    picked = evaluate_once(
        parse_feed(feed, names.METER_FIELDS, names.LATITUDE + names.LONGITUDE, ["feed_pos", "raw"]),
        ["feed_pos", "raw", "pair", "location"],
        lat=first_of("number", names.LATITUDE),
        lng=first_of("number", names.LONGITUDE),
        has_plain=first_of("number", names.PLAIN_LATITUDE + names.PLAIN_LONGITUDE).isNotNull(),
        own_post_id=first_of("text", names.METER_POST_ID),
        meter_id=first_of("text", names.METER_ID + names.METER_OBJECT_ID),
        blockface_id=first_of("text", names.METER_BLOCKFACE),
        street_name=F.coalesce(first_of("text", names.METER_STREET), place_text()),
        street_num=first_of("text", names.STREET_NUMBER),
        meter_type=first_of("text", names.METER_TYPE),
        cap_color=first_of("text", names.CAP_COLOR),
        on_offstreet_type=first_of("text", names.ON_OFFSTREET),
        active_meter_flag=first_of("text", names.ACTIVE_FLAG),
        jurisdiction=first_of("text", names.JURISDICTION),
    )
    lat, lng = parse_point(F.col("lat"), F.col("lng"), F.col("pair"), F.col("location"))
    kept = [c for c in picked.columns if c not in ("location", "lat", "lng", "pair")]
    # The source id is a row value here: as a literal it would be folded out of later joins and groupings.
    placed = evaluate_once(picked, kept, source_id=F.lit(source_id), latitude=lat, longitude=lng)
    on_globe = valid_coordinate(F.col("latitude"), F.col("longitude"))
    skip_reason = (
        F.when(~on_globe & F.col("has_plain"), INVALID_COORDINATES)
        .when(~on_globe, MISSING_COORDINATES)
        .when(F.col("meter_id").isNull(), MISSING_METER_ID)
    )
    return placed.select(
        "source_id",
        "feed_pos",
        F.col("meter_id").alias("external_id"),
        F.coalesce("own_post_id", "meter_id").alias("post_id"),
        "blockface_id",
        "street_name",
        "street_num",
        "latitude",
        "longitude",
        "meter_type",
        "cap_color",
        "on_offstreet_type",
        "active_meter_flag",
        "jurisdiction",
        F.col("raw").alias("raw_payload"),
        imported_at.alias("imported_at"),
        imported_at.alias("updated_at"),
        skip_reason.alias("skip_reason"),
    )


def meter_rows(mapped: DataFrame) -> DataFrame:
    """Usable meters, one per key; of repeated keys the last in the feed counts."""
    usable = mapped.where(F.col("skip_reason").isNull()).drop("skip_reason")
    rows = latest_per_key(usable, ["source_id", "external_id"], ["feed_pos"]).drop("feed_pos")
    return rows.select(row_id(F.col("source_id"), F.col("external_id")).alias("id"), "*")


def map_blocks(feed: DataFrame, source_id: str, imported_at: Column) -> DataFrame:
    """Every feed row as a block; coordinates are taken as they come.

    A space count that is no whole number cannot be stored: `skip_reason`.
    Rows without any id are keyed by the hash of their text.
    """
    row_key = F.coalesce(first_of("text", names.BLOCK_ROW_ID), F.sha2("raw", 256))
    picked = evaluate_once(
        parse_feed(
            feed, names.BLOCK_FIELDS, names.LATITUDE + names.LONGITUDE + names.SPACES, ["feed_pos", "raw"]
        ),
        ["feed_pos", "raw"],
        source_id=F.lit(source_id),
        blockface_id=first_of("text", names.BLOCK_BLOCKFACE),
        external_id=F.coalesce(
            first_of("text", names.BLOCK_ID + names.BLOCK_BLOCKFACE), F.concat(F.lit("row-"), row_key)
        ),
        street_name=first_of("text", names.BLOCK_STREET),
        cross_street_from=first_of("text", names.CROSS_FROM),
        cross_street_to=first_of("text", names.CROSS_TO),
        spaces=first_of("number", names.SPACES),
        latitude=F.coalesce(first_of("number", names.LATITUDE), F.col("location.latitude")),
        longitude=F.coalesce(first_of("number", names.LONGITUDE), F.col("location.longitude")),
    )
    spaces = F.col("spaces")
    return picked.select(
        "source_id",
        "feed_pos",
        "external_id",
        "blockface_id",
        "street_name",
        "cross_street_from",
        "cross_street_to",
        F.when(is_whole(spaces), spaces.try_cast("int")).alias("spaces_count"),
        "latitude",
        "longitude",
        F.col("raw").alias("raw_payload"),
        imported_at.alias("imported_at"),
        imported_at.alias("updated_at"),
        F.when(~is_whole(spaces), INVALID_SPACES).alias("skip_reason"),
    )


def block_rows(mapped: DataFrame) -> DataFrame:
    """Usable blocks, one per key; of repeated keys the last in the feed counts."""
    usable = mapped.where(F.col("skip_reason").isNull()).drop("skip_reason")
    rows = latest_per_key(usable, ["source_id", "external_id"], ["feed_pos"]).drop("feed_pos")
    return rows.select(row_id(F.col("source_id"), F.col("external_id")).alias("id"), "*")


def blockface_index(blocks: DataFrame) -> DataFrame:
    """(blockface_id, block_id): one block per blockface, the one with the least key."""
    with_face = blocks.where(F.col("blockface_id").isNotNull()).select("blockface_id", "external_id", "id")
    return first_per_key(with_face, ["blockface_id"], ["external_id", "id"]).select(
        "blockface_id", F.col("id").alias("block_id")
    )


def attach_blocks(meters: DataFrame, blocks: DataFrame, **join_options) -> DataFrame:
    """Meters with `block_id`; many meters have no blockface, some share a busy one."""
    return lookup_join(
        meters, blockface_index(blocks), ["blockface_id"], "left", salt_by=["external_id"], **join_options
    )


def map_regulations(feed: DataFrame) -> DataFrame:
    """Feed rows as block patches; `storable` is false for a fractional hour limit."""
    limit = first_of("number", names.HOUR_LIMIT)
    return evaluate_once(
        parse_feed(feed, names.RULE_FIELDS, names.HOUR_LIMIT, ["feed_pos"]),
        ["feed_pos"],
        blockface_id=first_of("text", names.RULE_BLOCKFACE + names.RULE_NAME),
        regulation_type=first_of("text", names.RULE_TYPE),
        agency=first_of("text", names.AGENCY),
        days_of_week=first_of("text", names.DAYS),
        hours=first_of("text", names.HOURS),
        hour_limit=F.when(is_whole(limit), limit.try_cast("int")),
        permit_area=first_of("text", names.PERMIT_AREA),
        storable=is_whole(limit),
    )


def match_regulations(regulations: DataFrame, blocks: DataFrame, **join_options) -> DataFrame:
    """Regulations with `block_id` and `matched`."""
    joined = lookup_join(
        regulations, blockface_index(blocks), ["blockface_id"], "left", salt_by=["feed_pos"], **join_options
    )
    return joined.withColumn("matched", F.col("block_id").isNotNull() & F.col("storable"))


def match_counts(matched: DataFrame) -> DataFrame:
    return matched.agg(
        F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("unmatched")
    )


def last_patches(matched: DataFrame) -> DataFrame:
    """Per matched block (`id`) the fields of its last regulation in feed order."""
    patches = matched.where("matched").select("block_id", "feed_pos", *REGULATION)
    return latest_per_key(patches, ["block_id"], ["feed_pos"]).select(F.col("block_id").alias("id"), *REGULATION)


def regulated(blocks: DataFrame) -> DataFrame:
    """`id` and regulation of the blocks that have one."""
    present = [c for c in REGULATION if c in blocks.columns]
    some = F.coalesce(*[F.col(c).cast("string") for c in present], F.lit(None).cast("string")).isNotNull()
    return blocks.select("id", *present).where(some)


def merge_regulations(blocks: DataFrame, matched: DataFrame, imported_at: Column) -> DataFrame:
    """Blocks with the fields of their last matching regulation in feed order."""
    last = last_patches(matched).select("id", F.struct(*REGULATION).alias("_patch"))
    joined = unique_join(blocks, last, ["id"])
    patched = F.col("_patch").isNotNull()
    known = [c for c in blocks.columns if c not in REGULATION]
    old = {c: F.col(c) for c in REGULATION if c in blocks.columns}
    times = ("imported_at", "updated_at")
    return joined.select(
        *[F.when(patched, imported_at).otherwise(F.col(c)).alias(c) if c in times else F.col(c) for c in known],
        *[F.when(patched, F.col(f"_patch.{c}")).otherwise(old.get(c, F.lit(None))).alias(c) for c in REGULATION],
    )
