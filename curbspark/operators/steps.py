"""Steps of a longer job, written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from curbspark.session import shared_dir


def written(df: DataFrame, purpose: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and its size is known to the joins that follow."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
