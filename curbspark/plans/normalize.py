"""Clean meter view and the normalized location table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbspark.functions.geo import valid_coordinate
from curbspark.functions.text import non_blank, trim_blanks
from curbspark.operators.latest import latest_per_key
from curbspark.operators.once import evaluate_once
from curbspark.operators.skew import lookup_join
from curbspark.plans.ingest import row_id

# Constants of normalized rows.
SOURCE_TYPE = "datasf_parking_meter"
CITY = "San Francisco"
STATE = "CA"
METER_TABLE = "city_parking_meters"
INACTIVE_FLAGS = ("N", "NO", "INACTIVE", "0", "FALSE", "F")

SKIP_SOURCE_ID = "missing_source_id"
SKIP_COORDINATES = "invalid_coordinates"
NORMALIZE_SKIPS = (SKIP_COORDINATES, SKIP_SOURCE_ID)

_SOURCE_FIELDS = ("source_key", "dataset_id", "display_name", "provider")


def with_source(meters: DataFrame, sources: DataFrame, **join_options) -> DataFrame:
    """Meters with `source`, a struct of their registry row, null if unknown.

    One source may own most meters; the registry is broadcast when small and
    the hot source is salted when not.
    """
    embedded = sources.select(F.col("id").alias("source_id"), F.struct(*_SOURCE_FIELDS).alias("source"))
    return lookup_join(meters, embedded, ["source_id"], "left", salt_by=["external_id"], **join_options)


def clean_meters(meters: DataFrame, sources: DataFrame, **join_options) -> DataFrame:
    """Flat inspection view over meters and their source."""
    street_line = F.trim(F.concat_ws(" ", "street_num", "street_name"))
    return with_source(meters, sources, **join_options).select(
        F.col("id").alias("meter_row_id"),
        F.coalesce("post_id", "external_id").alias("meter_id"),
        F.col("active_meter_flag").alias("status"),
        "latitude",
        "longitude",
        F.nullif(street_line, F.lit("")).alias("location_description"),
        F.col("imported_at").alias("last_ingested_at"),
        F.col("source.display_name").alias("source_name"),
        F.col("source.source_key").alias("source_key"),
        F.col("source.dataset_id").alias("source_dataset_id"),
        "blockface_id",
        "meter_type",
        "cap_color",
        "on_offstreet_type",
        "jurisdiction",
        "updated_at",
    )


def address_line(street_num: Column, street_name: Column) -> Column:
    number, street = non_blank(street_num), non_blank(street_name)
    line = F.concat_ws(" ", number, street)
    return F.when(street.isNotNull(), F.concat(line, F.lit(f", {CITY}, {STATE}")))


def is_active(flag: Column) -> Column:
    """Only a listed no-word makes a meter inactive; unknown flags stay active."""
    return ~F.coalesce(F.upper(trim_blanks(flag)).isin(*INACTIVE_FLAGS), F.lit(False))


def restriction_text(**parts: Column) -> Column:
    """`name:value; name:value` of the non-empty parts, null if there are none."""
    texts = [F.when(value != "", F.concat(F.lit(f"{name}:"), value)) for name, value in parts.items()]
    return F.nullif(F.concat_ws("; ", *texts), F.lit(""))


def provenance() -> Column:
    """JSON object that says where a normalized row came from."""
    return F.to_json(
        F.struct(
            F.lit(METER_TABLE).alias("city_table"),
            F.col("id").alias("city_row_id"),
            "external_id",
            "post_id",
            "blockface_id",
            F.col("source.source_key").alias("source_key"),
            F.col("source.dataset_id").alias("dataset_id"),
            F.col("source.display_name").alias("source_display_name"),
            F.col("source.provider").alias("provider"),
            F.date_format("imported_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("imported_at"),
        ),
        {"ignoreNullFields": "false"},
    )


def map_locations(meters_with_source: DataFrame, synced_at: Column) -> DataFrame:
    """Every meter as a location with `skip_reason`, null where it is usable."""
    mapped = evaluate_once(
        meters_with_source,
        ["latitude", "longitude", "external_id"],
        source_type=F.lit(SOURCE_TYPE),
        source_id=F.coalesce(non_blank(F.col("post_id")), non_blank(F.col("external_id"))),
        address=address_line(F.col("street_num"), F.col("street_name")),
        active=is_active(F.col("active_meter_flag")),
        restrictions=restriction_text(
            cap_color=F.col("cap_color"),
            location=F.col("on_offstreet_type"),
            jurisdiction=F.col("jurisdiction"),
            meter_type=F.col("meter_type"),
        ),
        raw_source=provenance(),
        last_synced_at=F.coalesce("imported_at", synced_at),
    )
    on_globe = valid_coordinate(F.col("latitude"), F.col("longitude"))
    return mapped.select(
        "source_type",
        "source_id",
        "latitude",
        "longitude",
        "address",
        F.lit("METERED").alias("parking_type"),
        F.lit(None).cast("string").alias("time_limit"),
        "active",
        "restrictions",
        F.lit(CITY).alias("city"),
        "raw_source",
        "last_synced_at",
        synced_at.alias("updated_at"),
        F.col("external_id").alias("_external_id"),
        F.when(F.col("source_id").isNull(), SKIP_SOURCE_ID).when(~on_globe, SKIP_COORDINATES).alias("skip_reason"),
    )


def location_rows(mapped: DataFrame) -> DataFrame:
    """Usable locations, one per key: the newest import, then the greater id."""
    usable = mapped.where(F.col("skip_reason").isNull()).drop("skip_reason")
    newest = latest_per_key(usable, ["source_type", "source_id"], ["last_synced_at", "_external_id"])
    return newest.drop("_external_id").select(
        row_id(F.col("source_type"), F.col("source_id")).alias("id"), "*"
    )


def normalize(meters: DataFrame, sources: DataFrame, synced_at: Column, **join_options) -> DataFrame:
    """Meters to location rows ready for a keyed upsert."""
    return location_rows(map_locations(with_source(meters, sources, **join_options), synced_at))


def project_spots(locations: DataFrame, source: str, at: Column) -> DataFrame:
    """City inventory as spot rows: never more than UNKNOWN until someone reports.

    Keyed by (source, external_id).  The upsert should keep the status of known
    rows, which may stem from reports, and guard MOCK rows.
    """
    # A house number leads the line; an ordinal belongs to the street's name.
    street = F.regexp_extract("address", r"(?i)^(?:(?!\d+(?:ST|ND|RD|TH)\b)\d\S* )?([^,]+)", 1)
    return locations.select(
        F.lit(source).alias("source"),
        F.col("source_id").alias("external_id"),
        F.coalesce(F.nullif(street, F.lit("")), F.lit("Unknown")).alias("street_name"),
        "address",
        "latitude",
        "longitude",
        F.lit("UNKNOWN").alias("status"),
        "parking_type",
        "time_limit",
        at.alias("imported_at"),
    )
