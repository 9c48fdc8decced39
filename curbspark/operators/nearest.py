"""The k nearest locations of every point, however far away.

Locations are counted in a pyramid of grid cells. For every cell that holds points,
a search goes down the pyramid: it keeps the cells that may still hold one of the k
nearest, which are those whose least distance is no more than the distance within
which k locations are certain. Distances are bounded between the boxes that the
points and the locations of two cells fill, so that a cell with a single one is as
good as its place. Cells are thus pruned before any pair of rows
exists, and rings around a point need no radius. Only rows of the cells left at the
bottom are compared.

Places and points at equal coordinates are one: a place keeps its k least keys, and
a point's list is looked up by all points there, so that neither a hot place nor a
hot point is more than one row of the search.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbspark.functions import geo
from curbspark.operators.skew import UNKNOWN_BYTES, lookup_join
from curbspark.operators.steps import written

#: Levels of the pyramid. A level has 2**level rows and columns; the last one has cells of 19 m by 38 m.
LEVELS = (4, 8, 11, 14, 16, 18, 20)
#: Bounds are widened by this share, and angles by as many radians, against rounding.
_SLACK = 1e-9
_BOX = ("south", "north", "west", "east")


def _cell(degrees: Column, whole: int, level: int) -> Column:
    """Number of a cell of the level; the last one is closed."""
    return F.least(F.floor((degrees + whole / 2) * ((1 << level) / whole)), F.lit((1 << level) - 1)).cast("int")


def with_cell(places: DataFrame, lat: str, lng: str) -> DataFrame:
    return places.withColumns({"row": _cell(F.col(lat), 180, LEVELS[-1]), "col": _cell(F.col(lng), 360, LEVELS[-1])})


def _boxes(rows: DataFrame, lat: str, lng: str) -> DataFrame:
    """row, col, n and the box in radians of the rows of every cell of the last level."""
    y, x = geo.radians(F.col(lat)), geo.radians(F.col(lng))
    return rows.groupBy("row", "col").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(y).alias("south"), F.max(y).alias("north"), F.min(x).alias("west"), F.max(x).alias("east"),
    )


def _level(boxes: DataFrame, level: int, prefix: str = "") -> DataFrame:
    """The boxes of a level; its columns begin with the prefix."""
    rise = LEVELS[-1] - level
    joined = {"n": F.sum, "south": F.min, "north": F.max, "west": F.min, "east": F.max}
    return boxes.groupBy(*[F.shiftright(c, rise).alias(f"{prefix}{c}") for c in ("row", "col")]).agg(
        *[f(c).alias(f"{prefix}{c}") for c, f in joined.items()]
    )


def _chords(a: str, b: str) -> tuple[Column, Column]:
    """Least and most haversine (of an angle, the square of the sine of its half) between a place in one box and one in the other."""
    (s1, n1, w1, e1), (s2, n2, w2, e2) = ([F.col(f"{x}{side}") for side in _BOX] for x in (a, b))

    def cosines(south: Column, north: Column) -> tuple[Column, Column]:
        at_south, at_north = F.greatest(F.cos(south), F.lit(0.0)), F.greatest(F.cos(north), F.lit(0.0))
        most = F.when((south <= 0) & (north >= 0), 1.0).otherwise(F.greatest(at_south, at_north))
        return F.least(at_south, at_north), most

    def half_sine(angle: Column) -> Column:
        sine = F.sin(angle / 2)
        return sine * sine

    (least_1, most_1), (least_2, most_2) = cosines(s1, n1), cosines(s2, n2)
    lat_least = F.greatest(s2 - n1 - _SLACK, s1 - n2 - _SLACK, F.lit(0.0))
    lat_most = F.least(F.greatest(n2 - s1, n1 - s2) + _SLACK, F.lit(math.pi))
    # Eastward from one box to the other and the other way round.
    gap = F.greatest(w2 - e1, w1 - e2)
    reach = F.greatest(e2 - w1, e1 - w2)
    lng_least = F.greatest(F.least(gap, 2 * math.pi - reach) - _SLACK, F.lit(0.0))
    lng_most = F.least(F.greatest(reach, F.lit(0.0)) + _SLACK, F.when(gap > 0, 2 * math.pi - gap + _SLACK).otherwise(math.pi), F.lit(math.pi))
    least = half_sine(lat_least) + least_1 * least_2 * half_sine(lng_least)
    most = half_sine(lat_most) + most_1 * most_2 * half_sine(lng_most)
    return least, most


def _searched(wanted: DataFrame, counts: DataFrame, k: int, within: float = 1.0) -> DataFrame:
    """(row, col, place_row, place_col): for each wanted cell of the last level, the cells that may hold one of the
    k nearest places of any point in it, no farther than the haversine `within`. Both sides: see `_boxes`.

    Wanted cells go down together with their own ancestors, so that a level is searched once for all cells below.
    Kept cells meet the places' cells first and the wanted ones last: what then multiplies is not exchanged again."""
    found = None
    for above, level in zip((0, *LEVELS), LEVELS, strict=False):
        step = level - above
        here = _level(counts, level, "place_").withColumns(
            {"_up_row": F.shiftright("place_row", step), "_up_col": F.shiftright("place_col", step)}
        )
        own = _level(wanted, level).drop("n").withColumns(
            {"_own_row": F.shiftright("row", step), "_own_col": F.shiftright("col", step)}
        )
        if found is None:
            # All cells of the first level, at most 2**8 on each side, lie in the one above.
            whole = here.withColumnsRenamed({"_up_row": "_own_row", "_up_col": "_own_col"}).withColumn("_above", F.lit(within))
            pairs = own.join(F.broadcast(whole), ["_own_row", "_own_col"])
        else:
            kept = found.select(
                F.col("row").alias("_own_row"),
                F.col("col").alias("_own_col"),
                F.col("place_row").alias("_up_row"),
                F.col("place_col").alias("_up_col"),
                F.col("_certain").alias("_above"),
            )
            pairs = kept.join(here, ["_up_row", "_up_col"]).drop("_up_row", "_up_col").join(own, ["_own_row", "_own_col"])
        least, most = _chords("", "place_")
        cell = ("_own_row", "_own_col", "row", "col")
        pairs = pairs.select(
            *cell, "place_row", "place_col", F.col("place_n").alias("n"), "_above", least.alias("_least"), most.alias("_most")
        ).where(F.col("_least") <= F.col("_above") * (1 + _SLACK))
        nearest = Window.partitionBy(*cell).orderBy("_most", "place_row", "place_col").rowsBetween(Window.unboundedPreceding, 0)
        certain = F.min(F.when(F.col("_so_far") >= k, F.col("_most"))).over(Window.partitionBy(*cell))
        found = (
            pairs.withColumn("_so_far", F.sum("n").over(nearest))
            .withColumn("_certain", F.least(certain, F.col("_above")))
            .where(F.col("_least") <= F.col("_certain") * (1 + _SLACK))
            .select("row", "col", "place_row", "place_col", "_certain")
        )
    return found.drop("_certain")


def nearest_per_place(
    points: DataFrame, locations: DataFrame, k: int, point_lat: str, point_lng: str, location_key: str, within: float = 1.0
) -> DataFrame:
    """Per different place of the points the k nearest locations with all their columns, `distance_miles` and `nearness`."""
    places = with_cell(
        locations.where(geo.valid_coordinate(F.col("latitude"), F.col("longitude"))), "latitude", "longitude"
    )
    # Of places at one spot only the k least keys can be among the nearest.
    same_place = F.row_number().over(Window.partitionBy("latitude", "longitude").orderBy(location_key))
    places = places.withColumn("_same", same_place).where(F.col("_same") <= k).drop("_same")
    places = written(places, "nearest")
    spots = written(with_cell(points.select(point_lat, point_lng).distinct(), point_lat, point_lng), "nearest")
    counts = written(_boxes(places, "latitude", "longitude"), "nearest")
    wanted = written(_boxes(spots, point_lat, point_lng), "nearest")
    cells = _searched(wanted, counts, k, within)
    distance = geo.haversine_miles(F.col(point_lat), F.col(point_lng), F.col("latitude"), F.col("longitude"))
    pairs = (
        cells.join(places.withColumnsRenamed({"row": "place_row", "col": "place_col"}), ["place_row", "place_col"])
        .drop("place_row", "place_col")
        .join(spots, ["row", "col"])
        .withColumn("distance_miles", distance)
    )
    rank = F.row_number().over(Window.partitionBy("row", "col", point_lat, point_lng).orderBy("distance_miles", location_key))
    best = pairs.withColumn("nearness", rank).where(F.col("nearness") <= k)
    return best.select(point_lat, point_lng, *locations.columns, "distance_miles", "nearness")


def nearest_places(
    points: DataFrame,
    locations: DataFrame,
    k: int,
    *,
    point_key: str,
    location_key: str,
    point_lat: str = "point_latitude",
    point_lng: str = "point_longitude",
) -> DataFrame:
    """Per point the `k` nearest places (all, if there are fewer), with `distance_miles` and `nearness` from 1.

    Equally near places rank by key. Points and places without valid coordinates
    take no part. Column names of the two sides must differ. Places, points and
    counts are written to the shared folder once, as the search reads them often.
    """
    if k < 1:
        raise ValueError(f"invalid number of places: {k}")
    points = points.where(geo.valid_coordinate(F.col(point_lat), F.col(point_lng)))
    best = nearest_per_place(points, locations.select(location_key, "latitude", "longitude"), k, point_lat, point_lng, location_key)
    best = best.select(point_lat, point_lng, location_key, "distance_miles", "nearness")
    near = lookup_join(points, best, [point_lat, point_lng], "inner", salt_by=[point_key], lookup_bytes=UNKNOWN_BYTES)
    kept = [c for c in locations.columns if c != location_key]
    # The rest of a place's columns, for the few places that are anyone's nearest.
    rest = locations.select(location_key, *kept)
    return lookup_join(near, rest, [location_key], "inner", salt_by=[point_key, "nearness"]) if kept else near
