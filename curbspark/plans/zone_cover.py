"""Zones as a quadtree cover: cells of varying size that lie inside a zone or on its border.

A cell that no side of a zone's rings meets lies inside or outside as a whole, so
the point test is made once, for its middle. A cell that some side meets is cut
into smaller ones, which only that cell's own sides are tried against, down to
`DEPTH` steps below the zone's first level; then it is a border cell. A point in an
inner cell is in the zone without any test, and one in a border cell is tested
against the rings, which stay one row a zone and are joined by its id.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbspark.operators.skew import lookup_join
from curbspark.operators.steps import written

#: Levels that cells may have, coarse to fine. A level has 2**level cells in 360 degrees of longitude and of latitude.
LEVELS = (0, 2, 4, 6, 8, 10, 12, 14, 16, 18, 20, 22)
#: Steps of two levels that a border cell is cut below the zone's first level.
DEPTH = 3
#: Distances below this share of a cell count as touching.
_SLACK = 1e-6
_SIDE = ("x1", "y1", "x2", "y2")
_PLACE = ["zone_id", "level", "row", "col"]

#: Whether (lat, lng) lies within closed rings.
PointTest = Callable[[Column, Column, Column], Column]


class ZoneIndex(NamedTuple):
    """Tables that serve any number of lookups: the cover, and the rings of each zone once."""

    cover: DataFrame
    rings: DataFrame
    inside: PointTest


def _size(level: Column) -> Column:
    return F.lit(360.0) / F.pow(F.lit(2.0), level)


def _number(degrees: Column, level: Column) -> Column:
    return F.floor(degrees / _size(level)).cast("int")


def _touched() -> Column:
    """Whether the side meets the closed cell, or comes as near as rounding may matter."""
    size = _size(F.col("level"))
    middle_x, middle_y = (F.col("col") + 0.5) * size, (F.col("row") + 0.5) * size
    half = size * (0.5 + _SLACK)
    x1, y1, x2, y2 = (F.col(c) for c in _SIDE)
    overlaps = (
        (F.least(x1, x2) <= middle_x + half)
        & (F.greatest(x1, x2) >= middle_x - half)
        & (F.least(y1, y2) <= middle_y + half)
        & (F.greatest(y1, y2) >= middle_y - half)
    )
    dx, dy = x2 - x1, y2 - y1
    beside = F.abs(dx * (middle_y - y1) - dy * (middle_x - x1))
    return overlaps & (beside <= (F.abs(dx) + F.abs(dy)) * half)


def _sides(rings: DataFrame) -> DataFrame:
    """A row for each side of each ring, with its zone's first level; x and y count from the south-west corner of the map."""
    xs = lambda f: F.flatten(F.transform("rings", lambda r: F.transform(r, f)))
    lats, lngs = xs(lambda p: p["lat"]), xs(lambda p: p["lng"])
    extent = F.greatest(F.array_max(lats) - F.array_min(lats), F.array_max(lngs) - F.array_min(lngs))
    # The finest level whose cells are not smaller than the zone: it touches a few of them.
    fitting = F.array_max(F.filter(F.array(*map(F.lit, LEVELS[: -DEPTH])), lambda x: _size(x) >= extent))

    def sides_of(ring: Column) -> Column:
        last = F.greatest(F.size(ring) - 1, F.lit(0))
        return F.arrays_zip(F.slice(ring, F.lit(1), last).alias("a"), F.slice(ring, F.lit(2), last).alias("b"))

    return (
        rings.select(
            "zone_id",
            F.coalesce(fitting, F.lit(LEVELS[0])).alias("level"),
            F.explode(F.flatten(F.transform("rings", sides_of))).alias("s"),
        )
        .select(
            "zone_id",
            "level",
            (F.col("s.a.lng") + 180).alias("x1"),
            (F.col("s.a.lat") + 90).alias("y1"),
            (F.col("s.b.lng") + 180).alias("x2"),
            (F.col("s.b.lat") + 90).alias("y2"),
        )
        .where(" AND ".join(f"{c} IS NOT NULL" for c in _SIDE))
    )


def _cut(cells: DataFrame) -> DataFrame:
    """The sixteen cells two levels below, in place of each; what else a row holds stays."""
    return (
        cells.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(15))))
        .withColumns(
            {
                "row": (F.col("row") * 4 + F.shiftright("_part", 2)).cast("int"),
                "col": (F.col("col") * 4 + F.col("_part") % 4).cast("int"),
                "level": F.col("level") + 2,
            }
        )
        .drop("_part")
    )


def zone_index(zones: DataFrame, inside: PointTest) -> ZoneIndex:
    """The index of active zones with `rings` (see `rules.with_rings`): its steps and tables are in the shared folder."""
    rings = written(zones.where("is_active").select(F.col("id").alias("zone_id"), "rings"), "zone-rings")
    sides, level = _sides(rings), F.col("level")
    # The first cells are no smaller than the zone, so each that it reaches into holds a side.
    held = written(
        sides.withColumn("row", F.explode(F.sequence(_number(F.least("y1", "y2"), level), _number(F.greatest("y1", "y2"), level))))
        .withColumn("col", F.explode(F.sequence(_number(F.least("x1", "x2"), level), _number(F.greatest("x1", "x2"), level))))
        .where(_touched()),
        "zone-cells",
    )
    free = None
    for _ in range(DEPTH):
        smaller = _cut(held.select(*_PLACE).distinct())
        held = written(_cut(held).where(_touched()), "zone-cells")
        untouched = smaller.join(held.select(*_PLACE), _PLACE, "left_anti")
        free = untouched if free is None else free.unionByName(untouched)
    border = held.select(*_PLACE).distinct().withColumn("inner", F.lit(False))
    size = _size(level)
    middle = inside((F.col("row") + 0.5) * size - 90, (F.col("col") + 0.5) * size - 180, F.col("rings"))
    inner = free.join(rings, "zone_id").where(middle).select(*_PLACE, F.lit(True).alias("inner"))
    return ZoneIndex(written(border.unionByName(inner), "zone-cover"), rings, inside)


def zones_of_places(places: DataFrame, index: ZoneIndex, *, key: str, **join_options) -> DataFrame:
    """(key, zone_id) for the places (key, latitude, longitude) in each zone.

    Every place looks its cell up at each level; a crowded cell is salted, and so
    is a zone whose border is crowded.
    """
    levels = F.transform(
        F.array(*map(F.lit, LEVELS)),
        lambda x: F.struct(
            x.alias("level"), _number(F.col("latitude") + 90, x).alias("row"), _number(F.col("longitude") + 180, x).alias("col")
        ),
    )
    located = places.where("latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180")
    located = located.select(key, "latitude", "longitude", F.inline(levels))
    met = lookup_join(located, index.cover, ["level", "row", "col"], "inner", salt_by=[key], **join_options)
    tested = lookup_join(met.where("NOT inner"), index.rings, ["zone_id"], "inner", salt_by=[key], **join_options)
    tested = tested.where(index.inside(F.col("latitude"), F.col("longitude"), F.col("rings")))
    return met.where("inner").select(key, "zone_id").unionByName(tested.select(key, "zone_id"))
