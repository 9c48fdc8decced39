"""Curb rules, sweeping windows and zones joined to spots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbspark.functions import schedule
from curbspark.functions.geo import METERS_PER_MILE
from curbspark.operators.latest import latest_per_key
from curbspark.operators.radius_join import radius_join
from curbspark.operators.skew import lookup_join
from curbspark.plans.zone_cover import ZoneIndex, zone_index, zones_of_places

# Fixed values.
ANCHOR_METERS = 25
NO_PARKING = "NO_PARKING"


def _repeated_ids(df: DataFrame) -> DataFrame:
    """Ids that several rows have, null included."""
    return df.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) | F.col("id").isNull()).select("id")


def _met_rules(spots: DataFrame, rules: DataFrame, anchor_meters: float, carried: list[str], **join_options) -> DataFrame:
    """spot_id, rule_id and the carried columns of the rule: same blockface, or rule anchor close by.

    A spot and a rule meet once, by their blockface or else by distance, so that
    no pair needs to be looked for among the others.
    """
    active = rules.where("is_active")
    rule = [F.col("id").alias("rule_id"), *carried]
    on_face = lookup_join(
        spots.where(F.col("blockface_id").isNotNull()).select(F.col("id").alias("spot_id"), "blockface_id"),
        active.where(F.col("blockface_id").isNotNull()).select("blockface_id", *rule),
        ["blockface_id"],
        "inner",
        salt_by=["spot_id"],
        **join_options,
    ).select("spot_id", "rule_id", *carried)
    anchors = active.select(
        *rule,
        F.col("blockface_id").alias("_rule_face"),
        F.col("anchor_latitude").alias("point_latitude"),
        F.col("anchor_longitude").alias("point_longitude"),
    )
    close = radius_join(
        anchors,
        spots.select(F.col("id").alias("spot_id"), F.col("blockface_id").alias("_spot_face"), "latitude", "longitude"),
        anchor_meters / METERS_PER_MILE,
        location_key="spot_id",
        **join_options,
    ).where(~F.coalesce(F.col("_spot_face") == F.col("_rule_face"), F.lit(False)))
    return on_face.unionByName(close.select("spot_id", "rule_id", *carried))


def _parts(spots: DataFrame, rules: DataFrame) -> tuple[tuple[DataFrame, DataFrame], list[tuple[DataFrame, DataFrame]]]:
    """Spots and rules whose ids no other row has, and the sides that the rest of the pairs come from.

    Only pairs of the rest can repeat.  Repeated ids are looked for at once; without any there is no rest.
    """
    plain, rest = [], []
    for side in (spots, rules):
        ids = _repeated_ids(side)
        some = not ids.isEmpty()
        known = ids.where(F.col("id").isNotNull())
        plain.append(side.where(F.col("id").isNotNull()).join(known, "id", "left_anti") if some else side)
        again = side.where(F.col("id").isNull()).unionByName(side.join(known, "id", "left_semi").select(*side.columns))
        rest.append(again if some else None)
    others = []
    if rest[0] is not None:
        others.append((rest[0], rules))
    if rest[1] is not None:
        others.append((plain[0], rest[1]))
    return (plain[0], plain[1]), others


def spot_rules(spots: DataFrame, rules: DataFrame, anchor_meters: float = ANCHOR_METERS, **join_options) -> DataFrame:
    """Distinct (spot_id, rule_id): same blockface, or rule anchor close by.

    Two equi joins and a union; one join on either condition would compare
    every spot with every rule.  Pairs are made distinct only where ids repeat.
    """
    plain, others = _parts(spots, rules)
    pairs = _met_rules(*plain, anchor_meters, [], **join_options)
    for sides in others:
        pairs = pairs.unionByName(_met_rules(*sides, anchor_meters, [], **join_options).distinct())
    return pairs


def detailed_rules(spots: DataFrame, rules: DataFrame, anchor_meters: float = ANCHOR_METERS, **join_options) -> DataFrame:
    """The rows of `with_rule(spot_rules(...))`.  Rules bring their columns along, so that pairs are not exchanged."""
    plain, others = _parts(spots, rules)
    carried = [c for c in rules.columns if c != "id"]
    face = {"blockface_id": "_face_of_rule"}
    # The blockface is also what spots and rules meet by.
    named = plain[1].withColumn(face["blockface_id"], F.col("blockface_id"))
    kept = [face.get(c, c) for c in carried]
    pairs = _met_rules(plain[0], named, anchor_meters, kept, **join_options)
    pairs = pairs.select("rule_id", "spot_id", *[F.col(face.get(c, c)).alias(c) for c in carried])
    for sides in others:
        met = _met_rules(*sides, anchor_meters, [], **join_options).distinct()
        pairs = pairs.unionByName(with_rule(met, rules, **join_options))
    return pairs


def with_rule(pairs: DataFrame, rules: DataFrame, **join_options) -> DataFrame:
    """Spot-rule pairs with the rule's columns; a rule may cover many spots."""
    named = rules.withColumnRenamed("id", "rule_id")
    return lookup_join(pairs, named, ["rule_id"], "inner", salt_by=["spot_id"], **join_options)


def strictest_rule(pairs_with_rule: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Per spot the rule of highest priority; equal ones by rule id.

    With the `rules` that the pairs were made from, pairs are reduced by priority and
    id alone, and the rule's columns are looked up for one row a spot.
    """
    if rules is None:
        return latest_per_key(pairs_with_rule, ["spot_id"], ["priority", "rule_id"])
    found = with_chosen_rule(strictest_ids(pairs_with_rule).select("spot_id", "rule_id"), rules)
    return found.select(pairs_with_rule.columns)


def with_chosen_rule(chosen: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows with the columns of their rule; of several rows of one id that of highest priority, which is the one that won."""
    named = rules.where(F.col("id").isNotNull()).withColumnRenamed("id", "rule_id")
    return chosen.join(latest_per_key(named, ["rule_id"], ["priority"]), "rule_id")


def strictest_ids(pairs_with_rule: DataFrame, **more: Column) -> DataFrame:
    """spot_id, priority and rule_id of the strictest rule, rule_count, and the greatest of each of `more`.

    In two hash aggregates over columns of fixed width: their memory grows with the spots of a task, not with its pairs.
    """
    per_priority = pairs_with_rule.groupBy("spot_id", "priority").agg(
        F.max("rule_id").alias("rule_id"), F.count(F.lit(1)).alias("rule_count"), *[F.max(c).alias(n) for n, c in more.items()]
    )
    return per_priority.groupBy("spot_id").agg(
        F.max("priority").alias("priority"),
        # Without any priority there is one row, that of null.
        F.coalesce(F.max_by("rule_id", "priority"), F.max(F.when(F.col("priority").isNull(), F.col("rule_id")))).alias("rule_id"),
        F.sum("rule_count").alias("rule_count"),
        *[F.max(n).alias(n) for n in more],
    )


def sweeping_status(sweeping: DataFrame, now: Column) -> DataFrame:
    """Sweeping rules with `in_force` and `next_start` at a local wall-clock time."""
    weekday, start, end = F.col("weekday"), F.col("start_time"), F.col("end_time")
    weeks = F.col("weeks_of_month")
    return sweeping.where("is_active").select(
        "*",
        F.coalesce(schedule.in_force(now, weekday, start, end, weeks), F.lit(False)).alias("in_force"),
        schedule.next_start(now, weekday, start, weeks).alias("next_start"),
    )


def spot_sweeping(spots: DataFrame, sweeping: DataFrame, now: Column, **join_options) -> DataFrame:
    """Per spot `sweeping_now` and `next_sweeping`; spots of swept blockfaces only.

    Windows reduce to one row per blockface before they meet the spots.
    """
    per_face = (
        sweeping_status(sweeping, now)
        .groupBy("blockface_id")
        .agg(F.bool_or("in_force").alias("sweeping_now"), F.min("next_start").alias("next_sweeping"))
    )
    return lookup_join(
        spots.select(F.col("id").alias("spot_id"), "blockface_id"),
        per_face,
        ["blockface_id"],
        "inner",
        salt_by=["spot_id"],
        **join_options,
    )


def allowed_now(spots: DataFrame, pairs_with_rule: DataFrame, sweeping: DataFrame, now: Column, **join_options) -> DataFrame:
    """(spot_id, allowed): no sweeping in force and no no-parking rule within its days and hours."""
    holds = schedule.in_hours(now, F.col("days_of_week"), F.col("hours"))
    banned = (
        pairs_with_rule.where(F.col("regulation_type") == NO_PARKING)
        .groupBy("spot_id")
        .agg(F.bool_or(holds).alias("_banned"))
    )
    swept = spot_sweeping(spots, sweeping, now, **join_options).select("spot_id", "sweeping_now")
    joined = (
        spots.select(F.col("id").alias("spot_id")).join(banned, "spot_id", "left").join(swept, "spot_id", "left")
    )
    blocked = F.coalesce("_banned", F.lit(False)) | F.coalesce("sweeping_now", F.lit(False))
    return joined.select("spot_id", (~blocked).alias("allowed"))


def with_rings(zones: DataFrame) -> DataFrame:
    """Zones with `rings`: all rings of all parts of their GeoJSON polygon or multipolygon, as (lat, lng) structs."""
    one = F.from_json("boundary_geojson", "coordinates array<array<array<double>>>")["coordinates"]
    several = F.from_json("boundary_geojson", "coordinates array<array<array<array<double>>>>")["coordinates"]
    kind = F.get_json_object("boundary_geojson", "$.type")
    rings = F.when(kind == "MultiPolygon", F.flatten(several)).otherwise(one)

    def located(ring: Column) -> Column:
        return F.transform(ring, lambda p: F.struct(F.get(p, 1).alias("lat"), F.get(p, 0).alias("lng")))

    return zones.withColumn("rings", F.transform(rings, located))


def in_rings(lat: Column, lng: Column, rings: Column) -> Column:
    """Even-odd test of a point against all closed rings: holes are outside, every part counts."""

    def sides_of(ring: Column) -> Column:
        last = F.greatest(F.size(ring) - 1, F.lit(0))
        return F.arrays_zip(F.slice(ring, F.lit(1), last).alias("a"), F.slice(ring, F.lit(2), last).alias("b"))

    sides = F.flatten(F.transform(rings, sides_of))

    def crossed(side: Column) -> Column:
        a, b = side["a"], side["b"]
        straddles = (a["lat"] > lat) != (b["lat"] > lat)
        meets = (b["lng"] - a["lng"]) * (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lng"]
        return straddles & F.coalesce(lng < meets, F.lit(False))

    return F.size(F.filter(sides, crossed)) % 2 == 1


def zones_of_points(spots: DataFrame, zones: DataFrame, index: ZoneIndex | None = None, **join_options) -> DataFrame:
    """(spot_id, zone_id) for active zones whose boundary holds the spot.

    `zones.rings` are closed arrays of (lat, lng).  Without an index one is built
    (see `zone_cover`); many lookups can share one.
    """
    index = index or zone_index(zones, in_rings)
    places = spots.select(F.col("id").alias("spot_id"), "latitude", "longitude")
    return zones_of_places(places, index, key="spot_id", **join_options)


def zones_by_code(spots: DataFrame, zones: DataFrame, **join_options) -> DataFrame:
    """(spot_id, zone_id) by equal zone code; whole districts share one code."""
    codes = zones.where("is_active").select("zone_code", F.col("id").alias("zone_id"))
    coded = spots.where(F.col("zone_code").isNotNull()).select(F.col("id").alias("spot_id"), "zone_code")
    return lookup_join(coded, codes, ["zone_code"], "inner", salt_by=["spot_id"], **join_options).select(
        "spot_id", "zone_id"
    )


def spot_context(
    spots: DataFrame, rules: DataFrame, sweeping: DataFrame, zones: DataFrame, now: Column, **join_options
) -> DataFrame:
    """Per spot: number of rules, strictest one, next sweeping, all zones, data age.

    Rules stay rows of `spot_rules`; here they are only aggregated, as a busy
    blockface has no bound on their number.  Each side is reduced to one row
    per spot first.
    """
    detailed = detailed_rules(spots, rules, **join_options)
    per_spot = strictest_ids(detailed, rules_imported_at=F.col("imported_at"))
    per_rule = with_chosen_rule(per_spot.drop("priority"), rules.select("id", "priority", "regulation_type"))
    per_sweep = spot_sweeping(spots, sweeping, now, **join_options).drop("blockface_id")
    per_zone = zones_of_points(spots, zones, **join_options).groupBy("spot_id").agg(
        F.array_join(F.array_sort(F.collect_set("zone_id")).cast("array<string>"), ",").alias("zone_ids")
    )
    ids = spots.select(F.col("id").alias("spot_id"))
    joined = ids.join(per_rule, "spot_id", "left").join(per_sweep, "spot_id", "left").join(per_zone, "spot_id", "left")
    return joined.select(
        "spot_id",
        F.coalesce("rule_count", F.lit(0)).alias("rule_count"),
        F.col("rule_id").alias("strictest_rule_id"),
        F.col("regulation_type").alias("strictest_regulation"),
        F.coalesce("sweeping_now", F.lit(False)).alias("sweeping_now"),
        "next_sweeping",
        "zone_ids",
        "rules_imported_at",
    )
