"""Landed open-data feeds as DataFrames of raw JSON records.

Downloading is not done here: a feed lies in a folder, as pages of one JSON
array each or as JSON lines, named so that file names sort in feed order.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Datasets, in the order in which they are imported.
DATASETS = ("blocks", "meters", "regulations")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Every record of a paged feed as (feed_pos, raw).

    `feed_pos` is a struct of page path and place in the page; it sorts in
    feed order.  A page that is no JSON array fails the read.
    """
    pages = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("page"), F.col("value")
    )
    records = F.from_json("value", "array<string>")
    problem = F.concat(F.lit("expected a JSON array in "), F.col("page"))
    checked = F.coalesce(records, F.raise_error(problem).cast("array<string>"))
    return pages.select("page", F.posexplode(checked).alias("item", "raw")).select(
        F.struct("page", "item").alias("feed_pos"), "raw"
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every record of a feed landed as JSON lines, as (feed_pos, raw).

    Large files are split between tasks.  `feed_pos` sorts in feed order: by
    file path, start of the split, and place within it.  Blank lines are no
    records.
    """
    return (
        spark.read.text(path)
        .select(
            F.struct(
                F.col("_metadata.file_path").alias("page"),
                F.col("_metadata.file_block_start").alias("split_start"),
                F.monotonically_increasing_id().alias("item"),
            ).alias("feed_pos"),
            F.col("value").alias("raw"),
        )
        .where(F.trim("raw") != "")
    )


def row_limit(limit: float | None = None, full: bool = False, default: float | None = None) -> int | None:
    """Rows to import: an explicit limit, else the environment's, else all of them.

    Limits hold as they are given.  Bad explicit limits are errors, bad
    environment limits are ignored, and a full import ignores the environment's.
    """
    finite = float("inf")
    if limit is not None:
        if not 1 <= limit < finite:
            raise ValueError(f"invalid row limit: {limit}")
        return int(limit)
    if default is not None and 1 <= default < finite and not full:
        return int(default)
    return None


def limit_rows(feed: DataFrame, limit: int | None) -> DataFrame:
    """First rows in feed order; the same rows on every run."""
    return feed if limit is None else feed.orderBy("feed_pos").limit(limit)


def spread(feed: DataFrame) -> DataFrame:
    """The same rows dealt to all tasks by size.

    Reading a record is cheap and parsing it is not: a feed of millions of records
    can lie in a file so small that one task would read and parse them all.
    """
    return feed.hint("rebalance")


def select_datasets(names: Iterable[str] | None = None) -> list[str]:
    """The named datasets in import order, all of them by default."""
    if names is None:
        return list(DATASETS)
    wanted = {name.strip() for name in names}
    unknown = sorted(wanted.difference(DATASETS))
    if unknown:
        raise ValueError(f"unknown dataset: {', '.join(unknown)}")
    return [name for name in DATASETS if name in wanted]
