"""The registry of city datasets and its import bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbspark.operators.upsert import upsert

# The datasets a run imports.
API_BASE = "https://data.sfgov.org/resource"
DEFINITIONS = {
    "blocks": (
        "datasf_metered_blocks",
        "SFMTA Metered Street Blocks",
        "27b3-yjjx",
        "List of street blocks with parking meters (DataSF).",
    ),
    "meters": (
        "datasf_parking_meters",
        "Parking Meters",
        "8vzz-qzz9",
        "SFMTA parking meter locations (DataSF).",
    ),
    "regulations": (
        "datasf_parking_regulations",
        "Parking Regulations (blockface map)",
        "hi6h-neyh",
        "Parking regulations except non-metered color curb — merged onto blocks by blockface.",
    ),
}
PROVIDER = "DATASF"
COLUMNS = ("id", "source_key", "display_name", "provider", "dataset_id", "api_base_url", "description")


def source_id(source_key: str) -> str:
    """Stable id of a registry row; a rerun must not make new ones."""
    return f"source:{source_key}"


def source_rows(spark: SparkSession, datasets: list[str]) -> DataFrame:
    """One registry row per dataset; the registry is as long as this list."""
    rows = []
    for name in datasets:
        key, title, dataset_id, text = DEFINITIONS[name]
        values = (source_id(key), key, title, PROVIDER, dataset_id, f"{API_BASE}/{dataset_id}.json", text)
        rows.append(F.struct(*[F.lit(v).alias(c) for c, v in zip(COLUMNS, values, strict=True)]))
    # Literals rather than a local list, so that Catalyst knows how small this is.
    return spark.range(1).select(F.inline(F.array(*rows)))


def register_sources(registry: DataFrame, rows: DataFrame, at: Column) -> DataFrame:
    """Keyed upsert of dataset definitions; ids and counters of known rows stay."""
    return upsert(
        registry,
        rows,
        ["source_key"],
        at=at,
        keep=["id"],
        defaults={"last_row_count": F.lit(0), "created_at": at},
    )


def record_imports(registry: DataFrame, counts: DataFrame, at: Column) -> DataFrame:
    """Set time and row count on the sources in `counts` (id, last_row_count)."""
    return upsert(
        registry, counts.withColumn("last_imported_at", at), ["id"], at=at, insert_new=False
    )
