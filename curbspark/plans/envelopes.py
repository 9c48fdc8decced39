"""The strictest rule of every spot, from rules folded before any spot is met.

Rules of one blockface fold to their strictest, and so do anchors at equal
coordinates.  The circle around each anchor is then covered by cells of a grid finer
than its radius: in a cell that lies wholly inside the circle the rule holds
wherever a spot stands, so that such a cell keeps only the strictest one.  Cells at
the circle's border keep the anchor, but only if its rule is stricter than the
cell's own, and the distance is worked out for spots of those cells alone.  A
spot thus meets one row of its blockface, one of its cell and the few border
anchors that could still matter, however many rules lie around it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbspark.functions import geo
from curbspark.operators.radius_join import grid_cell, reached_cells
from curbspark.operators.skew import lookup_join, plan_bytes
from curbspark.plans.rules import ANCHOR_METERS

#: Rows of cells that a radius is cut into.
SPLIT = 4
#: Cells that a circle reaches, about: the square of its rows. It estimates the size of the exploded anchors.
CELLS_PER_ANCHOR = (2 * SPLIT + 3) ** 2
#: A cell counts as inside only with so much to spare, beyond any rounding of its corners.
INSIDE = 1 - 1e-5
_CELL = ["_row", "_cell"]


def _strictest(df: DataFrame, keys: list[str]) -> DataFrame:
    """Greatest (priority, rule_id) per key; a null priority is the least.

    In two hash aggregates over narrow columns, which combine on the map side.
    """
    per_priority = df.groupBy(*keys, "priority").agg(F.max("rule_id").alias("rule_id"))
    return per_priority.groupBy(*keys).agg(
        F.max("priority").alias("priority"),
        # Without any priority there is one row, that of null.
        F.coalesce(F.max_by("rule_id", "priority"), F.max("rule_id")).alias("rule_id"),
    )


def _holds_cell(step: float, miles: float) -> Column:
    """Whether the whole cell lies in the anchor's circle.

    Away from the poles the point of a cell farthest from the anchor is a corner.
    """
    lat, lng = F.col("_anchor_lat"), F.col("_anchor_lng")
    south, north = F.col("_row") * step - 90, (F.col("_row") + 1) * step - 90
    widest = F.least(F.greatest(F.abs(south), F.abs(north)), F.lit(90.0))
    cells = F.greatest(F.floor(360 * F.cos(geo.radians(widest)) / step), F.lit(1))
    west, east = F.col("_cell") / cells * 360 - 180, (F.col("_cell") + 1) / cells * 360 - 180
    corners = [geo.haversine_miles(lat, lng, y, x) <= miles * INSIDE for y in (south, north) for x in (west, east)]
    away = (F.greatest(F.abs(lat), F.abs(south), F.abs(north)) + 2 * step * (SPLIT + 1) < 90) & (cells >= 8)
    return reduce(Column.__and__, corners, away)


def anchor_envelopes(rules: DataFrame, miles: float, step: float) -> tuple[DataFrame, DataFrame]:
    """(per inner cell the strictest rule, border rows with anchor and rule) of active rules with a valid anchor."""
    anchors = rules.where(F.col("is_active") & geo.valid_coordinate(F.col("anchor_latitude"), F.col("anchor_longitude")))
    folded = _strictest(
        anchors.select(
            F.col("anchor_latitude").alias("_anchor_lat"),
            F.col("anchor_longitude").alias("_anchor_lng"),
            F.col("id").alias("rule_id"),
            "priority",
        ),
        ["_anchor_lat", "_anchor_lng"],
    )
    reached = reached_cells(folded, step, miles * geo.KM_PER_MILE, "_anchor_lat", "_anchor_lng").withColumn(
        "_inside", _holds_cell(step, miles)
    )
    inner = _strictest(reached.where("_inside"), _CELL)
    held = inner.select(*_CELL, F.struct("priority", "rule_id").alias("_held"))
    border = reached.where("not _inside").join(held, _CELL, "left")
    stricter = F.col("_held").isNull() | (F.struct("priority", "rule_id") > F.col("_held"))
    return inner, border.where(stricter).drop("_inside", "_held")


def strictest_rules(spots: DataFrame, rules: DataFrame, anchor_meters: float = ANCHOR_METERS, **join_options) -> DataFrame:
    """(spot_id, rule_id, priority): of the rules on a spot's blockface or anchored close by, the one
    of highest priority, of equal ones the greatest id.

    The same rows as `rules.strictest_rule` over all pairs of spots and rules,
    without the pairs.  Spots that no rule holds for have no row; a spot
    without coordinates still has its blockface.
    """
    miles = anchor_meters / geo.METERS_PER_MILE
    step = math.degrees(miles * geo.KM_PER_MILE / geo.EARTH_KM) / SPLIT
    active = rules.where("is_active")
    faces = _strictest(
        active.where(F.col("blockface_id").isNotNull()).select("blockface_id", F.col("id").alias("rule_id"), "priority"),
        ["blockface_id"],
    )
    inner, border = anchor_envelopes(rules, miles, step)
    named = spots.select(F.col("id").alias("spot_id"), "blockface_id", "latitude", "longitude")
    placed = grid_cell(
        named.where(geo.valid_coordinate(F.col("latitude"), F.col("longitude"))).drop("blockface_id"), step
    )
    exploded = plan_bytes(rules) * CELLS_PER_ANCHOR

    def met(facts: DataFrame, lookup: DataFrame, keys: list[str], **options) -> DataFrame:
        found = lookup_join(facts, lookup, keys, "inner", salt_by=["spot_id"], **options, **join_options)
        return found.select("spot_id", "priority", "rule_id")

    near = geo.haversine_miles(F.col("_anchor_lat"), F.col("_anchor_lng"), F.col("latitude"), F.col("longitude")) <= miles
    parts = [
        met(named.where(F.col("blockface_id").isNotNull()).select("spot_id", "blockface_id"), faces, ["blockface_id"]),
        met(placed.select("spot_id", *_CELL), inner, _CELL, lookup_bytes=exploded),
        met(placed, border, _CELL, lookup_bytes=exploded, condition=near),
    ]
    return _strictest(reduce(DataFrame.unionByName, parts), ["spot_id"]).select("spot_id", "rule_id", "priority")
