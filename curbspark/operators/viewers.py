"""Live lists of viewers: who sees a spot after a change, and who saw it before.

A viewer looks at a box of the map and may ask for one status. A change takes a spot
from one place and status to another (or from or to nowhere). A viewer who sees the
new one is sent ENTER or UPDATE; one who only saw the old one is sent WITHDRAW, so
that a row which moves out of the box, loses the status or is deleted leaves the
list. Boxes are found through grid cells, at the level at which a box touches at
most four.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbspark.functions import geo
from curbspark.operators.skew import UNKNOWN_BYTES, lookup_join

#: Levels of the grid. A level has 2**level cells in 360 degrees.
LEVELS = (0, 2, 4, 6, 8, 10, 12, 14, 16)
SEEN = ("latitude", "longitude", "status")
#: A change: the key, its place in the feed, what was shown before and what is shown after (null: nothing).
SHOWN = "struct<latitude:double,longitude:double,status:string>"


def _cells(level: Column) -> Column:
    return F.pow(F.lit(2.0), level) / 360


def _number(degrees: Column, level: Column) -> Column:
    return F.floor(degrees * _cells(level)).cast("int")


def row_changes(feed: DataFrame, snapshot: DataFrame | None = None, key: str = "id", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """key, order, before, after of each change, in the order of the feed.

    INSERT and UPDATE carry latitude, longitude and status. An UPDATE or DELETE of a
    row that is not there changes nothing. The snapshot holds what is there first.
    """
    rows = feed.where(F.col(key).isNotNull()).select(key, *order, "op", F.struct(*SEEN).alias("_row"), F.lit(1).alias("_turn"))
    if snapshot is not None:
        first = snapshot.where(F.col(key).isNotNull()).select(key, F.lit("INSERT").alias("op"), F.struct(*SEEN).alias("_row"), F.lit(0).alias("_turn"))
        rows = rows.unionByName(first, allowMissingColumns=True)
    turns = Window.partitionBy(key).orderBy("_turn", *order)
    # What decides whether the row is there is the last insert or delete.
    there = F.coalesce(F.last(F.when(F.col("op") != "UPDATE", F.col("op") == "INSERT"), ignorenulls=True).over(turns), F.lit(False))
    after = F.when(F.col("_there"), F.col("_row"))
    return (
        rows.withColumn("_there", there)
        .withColumn("after", after)
        .withColumn("before", F.lag("after").over(turns))
        .where("_turn = 1 AND (before IS NOT NULL OR after IS NOT NULL)")
        .select(key, *order, "before", "after")
    )


def _placed(viewers: DataFrame) -> DataFrame:
    extent = F.greatest(F.col("north") - F.col("south"), F.col("east") - F.col("west"))
    level = F.coalesce(F.array_max(F.filter(F.array(*map(F.lit, LEVELS)), lambda x: 1 / _cells(x) >= extent)), F.lit(0))
    # Both ends count as inside, so that a box ends in the cell that its border lies in.
    return (
        viewers.where("south <= north AND west <= east")
        .withColumn("_level", level)
        .withColumn("_row", F.explode(F.sequence(_number(F.col("south") + 90, F.col("_level")), _number(F.col("north") + 90, F.col("_level")))))
        .withColumn("_col", F.explode(F.sequence(_number(F.col("west") + 180, F.col("_level")), _number(F.col("east") + 180, F.col("_level")))))
        .withColumnRenamed("status", "_wanted")
        .select("viewer_id", "south", "west", "north", "east", "_wanted", "_level", "_row", "_col")
    )


def _sees(shown: str) -> Column:
    at = F.col(shown)
    inside = at["latitude"].between(F.col("south"), F.col("north")) & at["longitude"].between(F.col("west"), F.col("east"))
    return F.coalesce(inside & (F.col("_wanted").isNull() | (at["status"] == F.col("_wanted"))), F.lit(False))


def viewer_messages(changed: DataFrame, viewers: DataFrame, key: str = "id", order: tuple[str, ...] = ("ts", "seq"), **join_options) -> DataFrame:
    """viewer_id, message, key, order and what is shown after, for changes (see `row_changes`) and viewers
    (viewer_id, south, west, north, east, status; a null status asks for all).

    A change is looked up by its new place and by its old one: the first gives ENTER and UPDATE, the second
    WITHDRAW, so that no viewer is told twice.
    """
    side = lambda name: F.struct(F.lit(name).alias("side"), F.col(name).alias("at"))
    sides = changed.select(key, *order, "before", "after", F.inline(F.array(side("after"), side("before"))))
    sides = sides.where(geo.valid_coordinate(F.col("at.latitude"), F.col("at.longitude")))
    levels = F.transform(
        F.array(*map(F.lit, LEVELS)),
        lambda x: F.struct(
            x.alias("_level"), _number(F.col("at.latitude") + 90, x).alias("_row"), _number(F.col("at.longitude") + 180, x).alias("_col")
        ),
    )
    looked = sides.select(key, *order, "before", "after", "side", F.inline(levels))
    placed = _placed(viewers)
    if changed.isStreaming:
        met = looked.join(placed, ["_level", "_row", "_col"])
    else:
        options = {"lookup_bytes": UNKNOWN_BYTES, **join_options}
        met = lookup_join(looked, placed, ["_level", "_row", "_col"], "inner", salt_by=[key, *order], **options)
    saw, sees = _sees("before"), _sees("after")
    message = F.when((F.col("side") == "after") & sees, F.when(saw, "UPDATE").otherwise("ENTER")).when(
        (F.col("side") == "before") & saw & ~sees, "WITHDRAW"
    )
    return (
        met.withColumn("message", message)
        .where("message IS NOT NULL")
        .select("viewer_id", "message", key, *order, *(F.when(F.col("message") != "WITHDRAW", F.col(f"after.{c}")).alias(c) for c in SEEN))
    )
