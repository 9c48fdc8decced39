"""One row per key, chosen by an order that has no ties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: list[str], order: list[str], aggregate) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = aggregate(F.struct(*rest), F.struct(*order))
    picked = df.groupBy(*keys).agg(row.alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Row with the greatest `order` per key.

    An aggregate rather than a ranking window: rows of a heavy key combine on
    the map side, so no task ever sees the whole group.
    """
    return _pick(df, keys, order, F.max_by)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Row with the least `order` per key."""
    return _pick(df, keys, order, F.min_by)
