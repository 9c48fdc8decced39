"""Evaluate wide expressions once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluate_once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """`df` with the kept columns and new ones that later steps only read.

    Catalyst would copy a projected expression into each later filter and
    projection that names it; chains of fallbacks over parsed JSON then grow
    exponentially and parse the text again at each copy.  A one-row generator
    is a place it does not copy across.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*keep, F.inline(F.array(row)))
