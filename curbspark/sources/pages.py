"""Reader of large JSON array pages that splits a page between tasks.

The text source cuts a file into byte ranges and each range at closing braces.
Whether a brace stands in a string, and how deep, depends on all that came
before it in the page. So the feed is read twice. The first pass sums up each
range by itself: whether it changes between inside and outside of strings, and
how much deeper it ends for either beginning. Running sums over the ranges of a
page give the state that each range begins in. The second pass starts from that
state, finds the exact borders of records and puts out those that lie within a
range; pieces of records that cross a border of ranges meet by page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curbspark.operators.steps import written

_ESCAPED = re.compile(r"\\.", re.DOTALL)

RANGE = "page string, split_start bigint"
_SUMMARY = f"{RANGE}, turns boolean, deeper_outside bigint, deeper_inside bigint"
_PIECE = f"{RANGE}, item bigint, begins boolean, ends boolean, raw string"


def _parts(piece: str) -> tuple[list[str], bool]:
    """The piece cut at its quotes, and whether it ends on the other side of a quote than it begins."""
    parts = (_ESCAPED.sub("", piece) if "\\" in piece else piece).split('"')
    return parts, len(parts) % 2 == 0


def _deeper(parts: list[str], inside: bool, ends_inside: bool) -> int:
    """Opening braces outside of strings, less the closing one that cut the piece off."""
    return sum(p.count("{") for p in parts[inside::2]) - (not ends_inside)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each range with a piece in it. `turns`: its end is inside a string if its beginning is not."""
    rows: dict[tuple, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            kept = rows.setdefault((row["page"], row["split_start"]), [False, 0, 0])
            parts, turns = _parts(row["value"])
            for begun_inside in (False, True):
                inside = begun_inside != kept[0]
                kept[1 + begun_inside] += _deeper(parts, inside, inside != turns)
            kept[0] ^= turns
    columns = list(zip(*((*k, *v) for k, v in rows.items()), strict=True)) or [[]] * 5
    types = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
    names = [field.split()[0] for field in _SUMMARY.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


class _Range:
    """The records of one range, from the state that it begins in."""

    def __init__(self, page: str, split_start: int, inside: bool, depth: int) -> None:
        self.key, self.inside, self.depth = (page, split_start), inside, depth
        self.item, self.first, self.open = 0, True, []
        self.begins = False

    def row(self, ends: bool) -> tuple:
        out = (*self.key, self.item, self.begins, ends, "".join(self.open))
        self.item, self.open, self.begins = self.item + 1, [], False
        return out

    def wrong(self, text: str) -> ValueError:
        return ValueError(f"expected a JSON array of objects in {self.key[0]}, found {text[:80]!r}")

    def take(self, piece: str) -> tuple | None:
        """The record that ends with this piece, if one does."""
        if self.depth < 0:
            raise self.wrong(piece)
        if self.depth == 0 and not self.inside:
            gap, brace, _ = piece.partition("{")
            head = "[" if self.first and self.key[1] == 0 else ","
            if not brace:
                if gap.strip() != "]" and (head, "".join(gap.split())) != ("[", "[]"):
                    raise self.wrong(piece)
                self.depth = -1
                return None
            if gap.strip() != head:
                raise self.wrong(piece)
            piece, self.begins = piece[len(gap) :], True
        self.first = False
        parts, turns = _parts(piece)
        ends_inside = self.inside != turns
        self.depth += _deeper(parts, self.inside, ends_inside)
        self.inside = ends_inside
        self.open.append(piece + "}")
        return self.row(ends=True) if self.depth == 0 and not self.inside else None


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
    names = [field.split()[0] for field in _PIECE.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    now: _Range | None = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if now is None or now.key != (row["page"], row["split_start"]):
                if now is not None and now.open:
                    out.append(now.row(ends=False))
                now = _Range(row["page"], row["split_start"], row["inside"], row["depth"])
            if record := now.take(row["value"]):
                out.append(record)
        if out:
            yield batch_of(out)
    if now is not None and now.open:
        yield batch_of([now.row(ends=False)])


def range_states(pieces: DataFrame) -> DataFrame:
    """(page, split_start, inside, depth): the state that each range begins in. A page that does not end fails."""
    before = Window.partitionBy("page").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    page = Window.partitionBy("page")
    summed = pieces.mapInArrow(_summaries, _SUMMARY)
    begun = summed.withColumn("inside", F.coalesce(F.count_if("turns").over(before) % 2 == 1, F.lit(False)))
    deeper = begun.withColumn("deeper", F.when(F.col("inside"), F.col("deeper_inside")).otherwise(F.col("deeper_outside")))
    # What follows the last brace counts as one step out of the array.
    whole = (F.sum("deeper").over(page) == -1) & (F.count_if("turns").over(page) % 2 == 0)
    problem = F.concat(F.lit("expected a JSON array of objects in "), F.col("page"))
    return deeper.select(
        "page",
        "split_start",
        "inside",
        F.when(whole, F.coalesce(F.sum("deeper").over(before), F.lit(0))).otherwise(F.raise_error(problem).cast("bigint")).alias("depth"),
    )


def read_split_pages(spark: SparkSession, path: str) -> DataFrame:
    """Every record of a paged feed as (feed_pos, raw), pages split between tasks.

    A page is one JSON array of objects, `raw` the text of one as it stands.
    `feed_pos` sorts in feed order: by file path, start of the byte range in which
    the record begins, and place within it.  Anything else than white space and
    single commas between records, and a page cut short, fail the read.  A file
    without any text is a page without records.

    What is broadcast is one row of numbers a byte range, a millionth of the feed.
    """
    pieces = spark.read.text(path, lineSep="}").select(
        F.col("_metadata.file_path").alias("page"), F.col("_metadata.file_block_start").alias("split_start"), "value"
    )
    states = written(range_states(pieces), "page-states")
    begun = pieces.join(F.broadcast(states), ["page", "split_start"], "left")
    missing = F.raise_error(F.lit("the feed changed while it was read")).cast("bigint")
    found = written(
        begun.withColumn("depth", F.coalesce("depth", missing)).mapInArrow(_records, _PIECE), "page-records"
    )
    whole = F.col("begins") & F.col("ends")
    # At most two pieces a range.
    order = Window.partitionBy("page").orderBy("split_start", "item")
    crossing = (
        found.where(~whole)
        .withColumn("_record", F.count_if("begins").over(order))
        .groupBy("page", "_record")
        .agg(F.array_sort(F.collect_list(F.struct("split_start", "item", "raw"))).alias("_pieces"))
        .select(
            "page",
            F.col("_pieces")[0]["split_start"].alias("split_start"),
            F.col("_pieces")[0]["item"].alias("item"),
            F.array_join("_pieces.raw", "").alias("raw"),
        )
    )
    records = found.where(whole).select("page", "split_start", "item", "raw").unionByName(crossing)
    return records.select(F.struct("page", "split_start", "item").alias("feed_pos"), "raw")
