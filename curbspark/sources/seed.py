"""Seed spots for development."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbspark.operators.integrity import split_by_rules
from curbspark.schemas import RULES

SEED_COLUMNS = (
    "street_name string, address string, latitude double, longitude double, status string, parking_type string,"
    "price string, time_limit string, source string"
)


def read_seed(spark: SparkSession, path: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """(spots, rejected rows) of a CSV file of seed spots with a header.

    Ids derive from place and street, so loading twice gives the same spots.
    """
    rows = spark.read.csv(path, schema=SEED_COLUMNS, header=True, enforceSchema=False)
    place = F.concat_ws("\u0001", "street_name", "address", "latitude", "longitude")
    spots = rows.select(
        F.sha2(place, 256).alias("id"), "*", at.alias("updated_at"), at.alias("created_at")
    )
    return split_by_rules(spots, RULES["parking_spots"])
