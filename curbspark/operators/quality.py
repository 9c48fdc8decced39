"""Data-quality reports over the city tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbspark.functions.geo import valid_coordinate

KEY = ["source_type", "source_id"]
VERIFY_SAMPLE = 10
CHECK_SAMPLE, CHECK_VALID_SAMPLE = 20, 5


def _invalid_point() -> Column:
    return ~valid_coordinate(F.col("latitude"), F.col("longitude"))


def verify_locations(locations: DataFrame) -> DataFrame:
    """One row: total, failure counts and `passed`; an empty table passes.

    Failures are counted per key on the way to the duplicate count, so the
    table is read and exchanged once.
    """
    raw = F.col("raw_source").cast("string")
    no_source = F.coalesce(F.size(F.json_object_keys(raw)) <= 0, F.lit(True))
    checks = {
        "invalid_coordinates": _invalid_point(),
        "missing_last_synced": F.col("last_synced_at").isNull(),
        "missing_raw_source": no_source,
        "missing_active": F.col("active").isNull(),
    }
    per_key = locations.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(test).alias(name) for name, test in checks.items()]
    )
    totals = per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in checks],
        F.count_if(F.col("_n") > 1).alias("duplicate_keys"),
    )
    failures = sum((F.col(name) for name in (*checks, "duplicate_keys")), F.lit(0))
    return totals.withColumn("passed", failures == 0)


def newest_locations(locations: DataFrame, limit: int = VERIFY_SAMPLE) -> DataFrame:
    return locations.orderBy(F.desc("last_synced_at"), *KEY).limit(limit)


def check_clean_meters(clean: DataFrame) -> DataFrame:
    """One row: total, latest ingest time, rows without a usable point."""
    return clean.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.max("last_ingested_at").alias("latest_ingested_at"),
        F.count_if(_invalid_point()).alias("invalid_coordinates"),
    )


def newest_valid_meters(clean: DataFrame) -> DataFrame:
    """Of the 20 newest rows, the first five with a usable point."""
    order = [F.desc("last_ingested_at"), F.asc("meter_id"), F.asc("meter_row_id")]
    newest = clean.orderBy(*order).limit(CHECK_SAMPLE)
    return newest.where(~_invalid_point()).orderBy(*order).limit(CHECK_VALID_SAMPLE)
