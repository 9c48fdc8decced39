"""Exact duplicates by content sort.

Splitters from a sample cut the order of the normalised bytes into ranges. Each
range is sorted externally, which puts equal texts side by side, and every row
is compared in full with the row before it. The order is: first characters,
digest, text, id. The digest stands for the rest of the bytes in the splitters,
which keeps them short, and the id at the end lets one large group of copies
spread over many ranges. A group that crosses the border of two ranges is put
together from the first and last row of each range.

Texts are equal when identical after each run of ASCII white space became one
space; null counts as empty. Of equal texts the smallest doc_id stays, null ids
last; of rows that also share the id exactly one stays. Every row gets a result
row. An empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbspark.llm.common import SPACE, shielded, staged, table, whole_text

#: Characters of the text in a splitter.
HEAD_CHARS = 16
#: Ranges for each shuffle partition, so that ranges of odd sizes even out.
RANGES_PER_PARTITION = 4
#: Most ranges. It bounds the splitters and the table of border rows.
MAX_RANGES = 1 << 15
#: Sampled rows for each range.
SAMPLE_PER_RANGE = 16

_KEY = ("_head", "text_sha256", "_id")


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]+", " ")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns(
        {
            # Of the whole normalised text, so that equal texts have equal heads whatever white space they begin with.
            "_head": F.substring(normalised(whole_text()), 1, HEAD_CHARS),
            "text_sha256": F.sha2(normalised(whole_text()), 256),
            "_id": F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)),
        }
    )


def splitters(docs: DataFrame, ranges: int) -> list[list]:
    """Keys that cut docs into about `ranges` equal parts, in order."""
    rows = docs.count()
    fraction = min(1.0, ranges * SAMPLE_PER_RANGE / max(rows, 1))
    sample = _keyed(docs.select("doc_id", "text").sample(fraction, seed=7)).select(*_KEY).orderBy(*_KEY).collect()
    step = max(1, len(sample) // ranges)
    return [list(row) for row in sample[step::step]]


def _range_of(cuts: list[list]) -> Column:
    """How many cuts are at or below the key: a binary search in a literal array."""
    if not cuts:
        return F.lit(0)
    schema = "array<struct<_head string, text_sha256 string, _id bigint>>"
    found = F.from_json(F.lit(json.dumps([dict(zip(_KEY, c, strict=True)) for c in cuts])), schema)
    key = F.struct(*_KEY)
    steps = [1 << b for b in reversed(range(len(cuts).bit_length()))]
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when(F.coalesce(F.get(found, at + step - 1) <= key, F.lit(False)), at + step).otherwise(at),
    )


def sorted_runs(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """docs with _range, _run (number of the row's group of copies in its range), _first (first of it)
    and, on the first and last row of each range only, _border (the normalised text)."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = splitters(docs, min(MAX_RANGES, ranges or RANGES_PER_PARTITION * partitions))
    order = Window.partitionBy("_range").orderBy("_head", "text_sha256", "_norm", "_id")
    return (
        _keyed(docs)
        .withColumn("_range", _range_of(cuts))
        .repartition("_range")
        # After the exchange, which carries each text once.
        .withColumn("_norm", normalised(whole_text()))
        .withColumns({"_before": F.lag("_norm").over(order), "_end": F.lead(F.lit(True)).over(order).isNull()})
        .withColumns(
            {
                "_first": F.coalesce(F.col("_norm") != F.col("_before"), F.lit(True)),
                "_border": F.when(F.col("_before").isNull() | F.col("_end"), F.col("_norm")),
            }
        )
        .withColumn("_run", F.sum(F.col("_first").cast("long")).over(order))
        .drop("_norm", "_before", "_end", "_head")
    )


def _groups_across(borders: DataFrame) -> DataFrame:
    """Of the runs at the borders of ranges, at most two a range: the range that their group starts in."""
    same = Window.partitionBy("_border")
    return borders.dropDuplicates(["_range", "_run"]).select(
        "_range",
        "_run",
        F.min("_range").over(same).alias("_starts"),
        *(
            [F.min("_keep").over(same).alias("_all_keep"), F.sum("_size").over(same).alias("_all_size")]
            if "_keep" in borders.columns
            else []
        ),
    )


def exact_groups(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    run = Window.partitionBy("_range", "_run")
    narrow = (
        sorted_runs(docs.select("doc_id", "text"), ranges)
        .drop("text")
        .withColumns({"_keep": F.min("_id").over(run), "_size": F.count(F.lit(1)).over(run)})
    )
    rows = staged(narrow, "dedup")
    across = _groups_across(rows.where("_border is not null").select("_range", "_run", "_keep", "_size", "_border"))
    return rows.join(F.broadcast(across), ["_range", "_run"], "left").select(
        "doc_id",
        F.nullif(F.coalesce("_all_keep", "_keep"), F.lit(2**63 - 1)).alias("keep_id"),
        F.coalesce("_all_size", "_size").alias("group_size"),
        (F.col("_first") & F.coalesce(F.col("_starts") == F.col("_range"), F.lit(True))).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """The rows that stay, columns as they came."""
    inner, back = shielded(docs, "doc_id", "text")
    rows = staged(sorted_runs(inner, ranges).where("_first or _border is not null"), "dedup")
    across = _groups_across(rows.where("_border is not null").select("_range", "_run", "_border"))
    return back(
        rows.where("_first")
        .join(F.broadcast(across), ["_range", "_run"], "left")
        .where("_starts is null or _starts = _range")
    )


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_copies(docs)


OP2_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept,
       sha256(t) AS text_sha256
FROM n
"""
