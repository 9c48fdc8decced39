"""The registered queries: each calls the library on whole derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curbspark import schemas
from curbspark.functions import geo
from curbspark.functions.payload import sanitize_payload
from curbspark.operators import (
    accounts,
    asof,
    changes,
    counts,
    favorites,
    integrity,
    quality,
    reports,
    serving,
    spot_admin,
    viewers,
)
from curbspark.operators.latest import latest_per_key
from curbspark.operators.once import evaluate_once
from curbspark.operators.nearest import nearest_places
from curbspark.operators.radius_join import nearest_per_point as radius_join_nearest
from curbspark.operators.radius_join import radius_join
from curbspark.operators.steps import written
from curbspark.operators.upsert import insert_if_absent, upsert
from curbspark.plans import city, ingest, normalize, rules, shape
from curbspark.plans.envelopes import strictest_rules as strictest_rule_of_spots
from curbspark.session import shared_dir
from curbspark.sources import registry
from curbspark.sources.feed import limit_rows, read_lines, row_limit, spread
from curbspark.sources.pages import read_split_pages
from curbspark.sources.seed import SEED_COLUMNS, read_seed
from curbspark.sources.tables import read_batches
from curbspark.streaming import blockfaces, jobs
from curbspark.streaming.viewers import viewer_writer
from fixtures import VIEWS, view, without_zone

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The customary test point and search radius in miles.
LAT, LNG, MILES = 37.7879, -122.4075, 0.5
FAR_LAT, FAR_LNG = 40.7128, -74.0060
USER = 7
SPOT = ["id", "street_name", "address", "status", "parking_type", "updated_at"]
FIELD_NAMES = [
    "active",
    "active_meter_flag",
    "blockface",
    "blockface_id",
    "cap_color",
    "lat",
    "latitude",
    "lng",
    "location",
    "longitude",
    "objectid",
    "post_id",
    "postid",
    "shape",
    "street",
    "street_name",
    "street_num",
    "street_number",
    "streetname",
]


def wall_clock(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def imported() -> Column:
    return wall_clock("2024-02-01 00:00:00")


def noon() -> Column:
    return wall_clock("2024-01-30 12:00:00")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def miles(df: DataFrame) -> DataFrame:
    return df.withColumn("distance_miles", geo.rounded_miles(F.col("distance_miles")))


# --- spot lists -----------------------------------------------------------


@query
def nearby_spots(spark, d):
    found = serving.nearest(view(spark, d, "spots"), LAT, LNG, MILES)
    return miles(found).select("id", "street_name", "distance_miles")


@query
def nearby_spots_unclipped(spark, d):
    found = serving.nearest(view(spark, d, "spots"), LAT, LNG, MILES, clip_box=False)
    return miles(found).select("id", "street_name", "distance_miles")


@query
def radius_leak_check(spark, d):
    return serving.radius_leaks(serving.within_radius(view(spark, d, "spots"), LAT, LNG, MILES), MILES)


@query
def latest_spots(spark, d):
    return serving.latest_spots(view(spark, d, "spots")).select(SPOT)


@query
def spots_in_box(spark, d):
    return serving.spots_in_box(view(spark, d, "spots"), LAT, LNG).select(SPOT)


@query
def visible_spot_count(spark, d):
    return counts.row_count(serving.spots_in_box(view(spark, d, "spots"), LAT, LNG))


@query
def nearby_with_fallback(spark, d):
    return serving.spots_with_fallback(view(spark, d, "spots"), FAR_LAT, FAR_LNG).select(*SPOT, "is_fallback")


@query
def nearby_without_fallback(spark, d):
    return serving.spots_with_fallback(view(spark, d, "spots"), LAT, LNG).select(*SPOT, "is_fallback")


@query
def spot_search(spark, d):
    return serving.search_text(view(spark, d, "spots"), "BUILD").select(SPOT)


@query
def spots_by_chip(spark, d):
    spots = view(spark, d, "spots")
    parts = [
        serving.by_chip(spots, chip).select(F.lit(chip).alias("chip"), "id")
        for chip in ("ALL", "AVAILABLE", "OCCUPIED", "METERED", "FREE")
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query
def spot_cards(spark, d):
    cards = serving.spot_cards(view(spark, d, "spots"), wall_clock("2024-01-28 18:30:00"))
    return cards.select(
        "id", "status_label", "type_label", "marker_color", "pin_color", "display_price", "updated_label", "time_ago"
    )


@query
def spot_by_id(spark, d):
    return serving.by_id(view(spark, d, "spots"), 42).select(SPOT)


@query
def available_search(spark, d):
    return serving.search_address(view(spark, d, "archive_spots"), "auto", available=True)


@query
def available_nearby(spark, d):
    found = serving.within_radius(view(spark, d, "archive_spots"), LAT, LNG, 1000 / 1609.344, clip_box=False)
    return miles(serving.available_only(found)).select("id", "address", "price", "distance_miles")


@query
def nearest_available(spark, d):
    available = serving.available_only(view(spark, d, "archive_spots"))
    return miles(serving.nearest(available, LAT, LNG, 1.0, clip_box=False)).select("id", "distance_miles")


@query
def dashboard_first_six(spark, d):
    return miles(serving.first_nearby(view(spark, d, "archive_spots"), LAT, LNG)).select(
        "id", "address", "available", "distance_miles"
    )


@query
def dashboard_first_available(spark, d):
    return serving.first_available(view(spark, d, "archive_spots"))


@query
def dashboard_stats(spark, d):
    mine = serving.own_rows(_favorites(spark, d), USER)
    return counts.dashboard_stats(view(spark, d, "archive_spots"), mine)


@query
def radius_join_pairs(spark, d):
    spots = view(spark, d, "spots").select("id", "latitude", "longitude")
    pairs = radius_join(view(spark, d, "points"), spots, MILES, location_key="id")
    return miles(pairs).select("point_id", "id", "distance_miles")


@query
def nearest_per_point(spark, d):
    spots = view(spark, d, "spots").select("id", "latitude", "longitude")
    near = radius_join_nearest(
        view(spark, d, "points"), spots, MILES, 3, point_key="point_id", location_key="id"
    )
    return miles(near).select("point_id", "id", "distance_miles", "nearness")


@query
def nearest_k_any_distance(spark, d):
    spots = view(spark, d, "spots").select("id", "latitude", "longitude")
    near = nearest_places(view(spark, d, "world_points"), spots, 3, point_key="point_id", location_key="id")
    return miles(near).select("point_id", "id", "distance_miles", "nearness")


# --- favorites, users, events ---------------------------------------------


def _favorites(spark, d) -> DataFrame:
    return favorites.current_favorites(view(spark, d, "favorite_log"))


@query
def favorites_current(spark, d):
    return _favorites(spark, d)


@query
def favorites_after_toggles(spark, d):
    log = view(spark, d, "favorite_log")
    changed = favorites.toggles(_favorites(spark, d), view(spark, d, "toggle_requests"))
    later = changed.withColumn("ts", F.col("ts") + F.expr("INTERVAL '60' DAY"))
    return favorites.current_favorites(log.unionByName(later)).select("user_id", "parking_spot_id")


@query
def my_favorites(spark, d):
    return favorites.favorites_of(_favorites(spark, d), USER)


@query
def is_favorite(spark, d):
    return favorites.is_favorite(_favorites(spark, d), USER, 8)


@query
def favorite_spots(spark, d):
    mine = serving.own_rows(_favorites(spark, d), USER)
    return serving.by_chip(view(spark, d, "spots"), "FAVORITES", mine).select(SPOT)


@query
def favorites_with_spot(spark, d):
    joined = favorites.favorites_with_spot(_favorites(spark, d), view(spark, d, "spots"))
    spot = F.col("parking_spot")
    return joined.select(
        "user_id", "parking_spot_id", "created_at", spot["street_name"].alias("street_name"), spot["status"].alias("status")
    )


@query
def favorite_ids(spark, d):
    return counts.distinct_favorites(_favorites(spark, d))


@query
def user_activity_counts(spark, d):
    return counts.user_activity(_favorites(spark, d), view(spark, d, "reports"))


@query
def own_report_count(spark, d):
    return counts.count_for_user(view(spark, d, "reports"), USER)


@query
def own_reports(spark, d):
    return serving.own_rows(view(spark, d, "reports"), USER)


@query
def event_rights(spark, d):
    rows = serving.event_rights(view(spark, d, "analytics_events"), USER)
    return rows.select("id", "user_id", "allowed")


@query
def report_rights(spark, d):
    return serving.insert_rights(view(spark, d, "reports"), USER).select("id", "user_id", "allowed")


@query
def event_rollup(spark, d):
    return counts.event_rollup(view(spark, d, "analytics_events"))


@query
def event_payload_keys(spark, d):
    events = evaluate_once(
        view(spark, d, "analytics_events"), ["id"], event_payload=sanitize_payload(F.col("event_payload"))
    )
    keyed = events.select("id", F.explode(F.json_object_keys("event_payload")).alias("payload_key"), "event_payload")
    return keyed.select("id", "payload_key", F.get_json_object("event_payload", "$.k").alias("k"))


@query
def sanitized_payloads(spark, d):
    return view(spark, d, "wide_payloads").select("id", sanitize_payload(F.col("event_payload")).alias("event_payload"))


@query
def waitlist_accepted(spark, d):
    inserted, _, _ = _waitlist(spark, d)
    return inserted


@query
def waitlist_already(spark, d):
    _, already, _ = _waitlist(spark, d)
    return already.select("seq", "email")


@query
def waitlist_invalid(spark, d):
    _, _, invalid = _waitlist(spark, d)
    return invalid


def _waitlist(spark, d):
    raw = view(spark, d, "waitlist_raw")
    taken = view(spark, d, "zones").select(F.concat(F.lit("user"), "id", F.lit("@example.com")).alias("email"))
    return accounts.join_waitlist(taken, raw, ["seq"])


@query
def profiles_from_signups(spark, d):
    users = view(spark, d, "users")
    existing = view(spark, d, "points").select(F.col("point_id").alias("id"))
    return accounts.add_profiles(existing, users)


def _profile_updates(spark, d) -> DataFrame:
    return accounts.check_profile_updates(view(spark, d, "profile_updates"))


@query
def profile_updates(spark, d):
    accepted = _profile_updates(spark, d).where(F.col("reject_reason").isNull())
    profiles = accounts.signup_profiles(view(spark, d, "users")).withColumn("updated_at", F.col("created_at"))
    return accounts.update_profiles(profiles, latest_per_key(accepted, ["id"], ["seq"]), noon())


@query
def profile_update_rejects(spark, d):
    return _profile_updates(spark, d).where(F.col("reject_reason").isNotNull()).select("seq", "reject_reason")


# --- city feeds -----------------------------------------------------------


def _sources(spark) -> DataFrame:
    rows = registry.source_rows(spark, ["blocks", "meters", "regulations"])
    typed = rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (
        ("last_imported_at", "timestamp_ntz"), ("last_row_count", "bigint"),
        ("created_at", "timestamp_ntz"), ("updated_at", "timestamp_ntz"))])
    return typed


def _plan(spark, d) -> city.CityPlan:
    return city.CityPlan(
        view(spark, d, "meter_feed"), view(spark, d, "block_feed"), view(spark, d, "regulation_feed"), _sources(spark), imported()
    )


METER = [
    "external_id", "post_id", "blockface_id", "street_name", "street_num", "latitude", "longitude",
    "cap_color", "active_meter_flag",
]


@query
def meter_ingest(spark, d):
    plan = _plan(spark, d)
    return plan.mapped_meters.where(F.col("skip_reason").isNull()).select("feed_pos", *METER)


@query
def meter_rejects(spark, d):
    plan = _plan(spark, d)
    return plan.mapped_meters.where(F.col("skip_reason").isNotNull()).select("feed_pos", "skip_reason", "raw_payload")


@query
def meter_skip_counts(spark, d):
    return _plan(spark, d).meter_counts()


@query
def limited_meter_counts(spark, d):
    feed = limit_rows(view(spark, d, "meter_feed"), row_limit(default=100))
    return counts.skip_counts(ingest.map_meters(feed, "s", imported()), ingest.METER_SKIPS)


@query
def meters_with_blocks(spark, d):
    plan = _plan(spark, d)
    named = plan.imported_blocks.select(F.col("id").alias("block_id"), F.col("external_id").alias("block_external_id"))
    return plan.meters.join(named, "block_id", "left").select("external_id", "blockface_id", "block_external_id")


@query
def block_ingest(spark, d):
    blocks = ingest.block_rows(ingest.map_blocks(view(spark, d, "block_feed"), "s", imported()))
    return blocks.select("external_id", "blockface_id", "street_name", "spaces_count", "latitude", "imported_at")


@query
def regulation_merge(spark, d):
    return _plan(spark, d).blocks.select(
        "external_id", "blockface_id", "street_name", "spaces_count", "regulation_type", "agency", "days_of_week",
        "hour_limit", "imported_at",
    )


@query
def regulation_match_counts(spark, d):
    return ingest.match_counts(_plan(spark, d).matched_regulations)


def _clean(spark, d) -> DataFrame:
    return normalize.clean_meters(_plan(spark, d).meter_rows, _sources(spark))


@query
def meters_clean(spark, d):
    return _clean(spark, d).select(
        "meter_id", "status", "latitude", "longitude", "location_description", "last_ingested_at", "source_name",
        "source_key", "source_dataset_id", "blockface_id", "cap_color",
    )


@query
def meters_embedded_source(spark, d):
    joined = normalize.with_source(_plan(spark, d).meter_rows, _sources(spark))
    return joined.select(
        "external_id", F.col("source.provider").alias("provider"), F.col("source.display_name").alias("display_name")
    )


@query
def missing_locations(spark, d):
    return serving.missing_location(_clean(spark, d)).select("meter_id")


def _locations(spark, d) -> DataFrame:
    return _plan(spark, d).locations


LOCATION = [
    "source_type", "source_id", "latitude", "longitude", "address", "parking_type", "time_limit", "active",
    "restrictions", "city", "last_synced_at",
]


@query
def normalized_locations(spark, d):
    return _locations(spark, d).select(*LOCATION)


@query
def location_provenance(spark, d):
    raw = F.from_json(
        "raw_source",
        "city_table string, external_id string, post_id string, blockface_id string, source_key string,"
        "dataset_id string, source_display_name string, provider string, imported_at string",
    )
    return _locations(spark, d).select("source_id", raw.alias("r")).select("source_id", "r.*")


@query
def normalize_counts(spark, d):
    plan = _plan(spark, d)
    mapped = normalize.map_locations(normalize.with_source(plan.meter_rows, _sources(spark)), imported())
    return counts.skip_counts(mapped, normalize.NORMALIZE_SKIPS)


@query
def typed_locations(spark, d):
    typed = serving.typed_location(_locations(spark, d))
    return typed.select("source_id", "latitude", "address", "active", "last_synced_at", F.get_json_object("raw_source", "$.provider").alias("provider"))


@query
def city_nearby(spark, d):
    found = serving.nearest(_locations(spark, d), 37.715, -122.415, 1.0, key="source_id")
    return miles(found).select("source_id", "distance_miles")


@query
def city_newest(spark, d):
    return serving.newest_in_city(_locations(spark, d), " san fran% ").select(*LOCATION)


@query
def city_active(spark, d):
    return serving.newest_active(_locations(spark, d)).select(*LOCATION)


@query
def quality_report(spark, d):
    return _plan(spark, d).quality()


@query
def unfiltered_quality_report(spark, d):
    plan = _plan(spark, d)
    mapped = plan.mapped_meters.withColumn("id", F.col("external_id")).drop("skip_reason")
    return quality.verify_locations(
        normalize.map_locations(normalize.with_source(mapped, _sources(spark)), imported())
    )


@query
def clean_view_report(spark, d):
    return quality.check_clean_meters(_clean(spark, d))


@query
def newest_valid_meters(spark, d):
    return quality.newest_valid_meters(_clean(spark, d).withColumn("meter_row_id", F.col("meter_id"))).select(
        "meter_id", "status", "latitude", "longitude", "location_description"
    )


@query
def newest_samples(spark, d):
    return quality.newest_locations(_locations(spark, d)).select("source_type", "source_id", "active", "address")


@query
def duplicate_keys(spark, d):
    mapped = _plan(spark, d).mapped_meters.where(F.col("skip_reason").isNull())
    return integrity.duplicate_keys(mapped, ["external_id"])


@query
def duplicate_key_examples(spark, d):
    mapped = _plan(spark, d).mapped_meters.where(F.col("skip_reason").isNull())
    return integrity.duplicate_keys(mapped, ["external_id"], limit=5)


@query
def source_registry(spark, d):
    """Registry after registering the datasets and recording what they imported."""
    plan = _plan(spark, d)
    known = _sources(spark).where("source_key = 'datasf_parking_meters'").withColumns(
        {"display_name": F.lit("Old name"), "last_row_count": F.lit(5).cast("bigint"),
         "created_at": wall_clock("2023-01-01 00:00:00"), "updated_at": wall_clock("2023-01-01 00:00:00")}
    )
    names = ["blocks", "meters", "regulations"]
    registered = registry.register_sources(known, registry.source_rows(spark, names), imported())
    written = {
        "blocks": plan.blocks.agg(F.count(F.lit(1)).alias("last_row_count")),
        "meters": plan.meter_rows.agg(F.count(F.lit(1)).alias("last_row_count")),
        "regulations": ingest.match_counts(plan.matched_regulations).select(F.col("matched").alias("last_row_count")),
    }
    rows = [written[n].select(F.lit(registry.source_id(registry.DEFINITIONS[n][0])).alias("id"), "last_row_count") for n in names]
    done = registry.record_imports(registered, rows[0].unionByName(rows[1]).unionByName(rows[2]), imported())
    return done.select("source_key", "display_name", "dataset_id", "last_imported_at", "last_row_count", "created_at", "updated_at")


@query
def import_audit(spark, d):
    plan = _plan(spark, d)
    old = plan.locations.where("active")
    state = upsert(old, plan.locations, ["source_type", "source_id"], at=imported(), with_change=True)
    audit = city.import_audit(
        state, plan.mapped_meters, "DATASF", "8vzz-qzz9", "normalized_parking_locations", imported(), noon()
    )
    return audit.select(
        "source", "source_dataset", "target_table", "status", "rows_fetched", "rows_inserted", "rows_updated",
        "rows_skipped", "rows_deleted",
    )


def _edited(df: DataFrame, key: str, text: str, gone: str) -> DataFrame:
    """An earlier state of a table: keys ending in 4 not there yet, in 6 with another text, in 8 also under a name since gone.

    Each row makes its own earlier rows, so that the table is not computed once for each kind.
    """
    ends = F.right(F.col(key), F.lit(1))

    def row(name: Column, value: Column) -> Column:
        return F.struct(name.alias(key), value.alias(text))

    own, old = F.col(key), F.when(ends == "6", "Old").otherwise(F.col(text))
    rows = F.when(ends == "8", F.array(row(own, old), row(F.concat(F.lit(gone), own), F.col(text)))).when(
        ends != "4", F.array(row(own, old))
    )
    return df.select(*[c for c in df.columns if c not in (key, text)], F.inline(rows)).select(*df.columns)


def _earlier_tables(spark, d, stored: bool = True) -> dict[str, DataFrame]:
    """What an earlier import left; blocks ending in 3 had no regulation then, those in 2 another one.

    An import leaves tables, so that a run over them reads each feed once for itself and
    never again for the earlier state; a dry run may take them as plans (not `stored`).
    """
    plan = _plan(spark, d)
    for name in ("meter_feed", "block_feed", "regulation_feed"):
        setattr(plan, name, spread(getattr(plan, name)))

    def kept(df: DataFrame, name: str) -> DataFrame:
        return written(df, f"earlier-{name}") if stored else df

    plan.imported_blocks = kept(plan.imported_blocks, "imported-blocks")
    plan.meter_rows = kept(plan.meter_rows, "meter-rows")
    ends = F.right(F.col("external_id"), F.lit(1))
    blocks = _edited(plan.blocks, "external_id", "street_name", "X").withColumns(
        {
            "hour_limit": F.when((ends == "2") & F.col("regulation_type").isNotNull(), 99).otherwise(F.col("hour_limit")),
            "id": ingest.row_id(F.col("source_id"), F.col("external_id")),
        }
    )
    blocks = blocks.withColumns({c: F.when(ends != "3", F.col(c)) for c in ingest.REGULATION})
    meters = _edited(plan.meters, "external_id", "street_name", "X").withColumns(
        {
            "id": ingest.row_id(F.col("source_id"), F.col("external_id")),
            "post_id": F.when(F.col("external_id").startswith("X"), F.col("external_id")).otherwise(F.col("post_id")),
        }
    )
    locations = _edited(plan.locations, "source_id", "address", "Y").withColumns(
        {"id": ingest.row_id(F.col("source_type"), F.col("source_id")), "created_at": imported()}
    )
    tables = {"blocks": blocks, "meters": meters, "locations": locations}
    return {"sources": _sources(spark), **{name: kept(df, name) for name, df in tables.items()}}


def _feeds(spark, d) -> dict[str, DataFrame]:
    return {n: view(spark, d, f"{n[:-1]}_feed") for n in ("blocks", "meters", "regulations")}


LOG = [
    "source", "source_dataset", "target_table", "status", "rows_fetched", "rows_inserted", "rows_updated", "rows_unchanged",
    "rows_deleted", "rows_skipped", "rows_repeated", "error_message",
]


@query
def import_run_log(spark, d):
    """A whole import run over the state that an earlier one left."""
    run = city.run_import(spark, _feeds(spark, d), _earlier_tables(spark, d), shared_dir(spark, "import"), imported())
    return run["log"].select(*LOG)


@query
def import_run_changes(spark, d):
    """Every key that the run did not find as it was."""
    run = city.run_import(spark, _feeds(spark, d), _earlier_tables(spark, d), shared_dir(spark, "import"), imported())
    named = run["changes"].where("target in ('meters', 'locations') and change <> 'unchanged'")
    return named.select(
        "target", F.coalesce(F.get_json_object("key", "$.external_id"), F.get_json_object("key", "$.source_id")).alias("key"), "change"
    )


def _landed_pages(spark, d, name: str) -> str:
    """A feed as files of one JSON array for each 500 places, named in feed order."""
    out = shared_dir(spark, f"landed-{name}")
    records = F.array_sort(F.collect_list(F.struct("feed_pos", "raw")))
    (
        view(spark, d, name)
        .groupBy(F.expr("lpad(feed_pos div 500, 9, '0')").alias("batch"))
        .agg(F.concat(F.lit("["), F.array_join(F.transform(records, lambda r: r["raw"]), "\n,"), F.lit("]")).alias("value"))
        .write.partitionBy("batch")
        .text(out)
    )
    return out


@query
def landed_page_records(spark, d):
    """Every record of the landed pages, with its place in its page."""
    rows = read_split_pages(spark, _landed_pages(spark, d, "meter_feed"))
    place = F.row_number().over(Window.partitionBy("feed_pos.page").orderBy("feed_pos"))
    batch = F.regexp_extract("feed_pos.page", r"batch=(\d+)", 1).cast("bigint")
    return rows.select(batch.alias("batch"), place.cast("bigint").alias("place"), "raw")


@query
def import_dry_run(spark, d):
    """What an import of the landed meter pages would count, without writing a table."""
    feeds = {"meters": read_split_pages(spark, _landed_pages(spark, d, "meter_feed"))}
    run = city.run_import(
        spark, feeds, _earlier_tables(spark, d, stored=False), shared_dir(spark, "import"), imported(), only=["meters"],
        dry_run=True,
    )
    return run["counts.meters"]


@query
def import_chosen_lines(spark, d):
    """Only the meters, landed as JSON lines."""
    out = shared_dir(spark, "landed-lines")
    view(spark, d, "meter_feed").orderBy("feed_pos").select("raw").write.text(out)
    run = city.run_import(
        spark, {"meters": read_lines(spark, out)}, _earlier_tables(spark, d), shared_dir(spark, "import"), imported(),
        only=["meters"],
    )
    return run["log"].select(*LOG)


@query
def seeded_spots(spark, d):
    """Spots written as seed files and loaded again; the rules of the table set rows aside."""
    out = shared_dir(spark, "seed")
    names = [field.split()[0] for field in SEED_COLUMNS.split(",")]
    rows = view(spark, d, "spots").withColumns(
        {
            "status": F.expr("if(id % 13 = 0, 'TAKEN', status)"),
            "longitude": F.expr("if(id % 29 = 0, null, longitude)"),
        }
    )
    rows.select(*names).write.csv(out, header=True)
    spots, rejected = read_seed(spark, out, imported())
    columns = ["street_name", "address", "latitude", "longitude", "status", "parking_type", "price"]
    good = spots.select(*columns, F.lit(True).alias("accepted"))
    return good.unionByName(rejected.select(*columns, F.lit(False).alias("accepted")))


@query
def import_run_stopped(spark, d):
    """Meters lack an expected field, so that only blocks and regulations are imported."""
    run = city.run_import(
        spark, _feeds(spark, d), _earlier_tables(spark, d), shared_dir(spark, "import"), imported(),
        expected={"meters": [*FIELD_NAMES, "jurisdiction"]},
    )
    return run["log"].select(*LOG)


@query
def schema_drift(spark, d):
    expected = [*[n for n in FIELD_NAMES if n != "streetname"], "jurisdiction"]
    return city.schema_drift(view(spark, d, "meter_feed"), expected)


@query
def schema_drift_fields(spark, d):
    expected = [*[n for n in FIELD_NAMES if n != "streetname"], "jurisdiction"]
    return city.drift_fields(view(spark, d, "meter_feed"), expected)


@query
def feed_shape(spark, d):
    """Kinds of values by field, over the feed's whole records."""
    found = shape.field_summary(shape.shape_sketch(view(spark, d, "meter_feed")))
    return found.select("field", "kinds", "records", "filled", "shapes", "depth")


@query
def feed_shape_drift(spark, d):
    before, now = (shape.shape_sketch(view(spark, d, n)) for n in ("meter_feed", "later_meter_feed"))
    return shape.shape_drift(before, now)


@query
def city_spot_projection(spark, d):
    """City rows projected onto the spot table; MOCK rows stay untouched."""
    spots = view(spark, d, "spots").select(
        "source", F.concat(F.lit("P"), F.col("id")).alias("external_id"), "street_name", "address", "latitude", "longitude",
        "status", "parking_type", "time_limit", "updated_at",
    )
    rows = normalize.project_spots(_locations(spark, d), "DATASF", imported()).drop("imported_at")
    state = upsert(
        spots, rows, ["source", "external_id"], at=imported(), keep=["status"], guard=F.col("source") != "MOCK"
    )
    return state.select("source", "external_id", "street_name", "address", "status", "parking_type", "updated_at")


# --- changes --------------------------------------------------------------


@query
def latest_report_status(spark, d):
    return reports.latest_status(view(spark, d, "reports"))


@query
def status_as_of(spark, d):
    """Every third probe asks for one spot."""
    probes = view(spark, d, "status_probes").withColumnRenamed("asked_at", "at")
    found = asof.status_as_of(view(spark, d, "reports"), probes, F.make_dt_interval(days=F.lit(30)))
    return found.withColumnRenamed("at", "asked_at")


@query
def apply_reports(spark, d):
    spots, _, _ = reports.submit_reports(view(spark, d, "spots"), view(spark, d, "reports"))
    return spots.select(SPOT)


@query
def accepted_reports(spark, d):
    _, accepted, _ = reports.submit_reports(view(spark, d, "spots"), view(spark, d, "reports"))
    return accepted


@query
def rejected_reports(spark, d):
    _, _, rejected = reports.submit_reports(view(spark, d, "spots"), view(spark, d, "reports"))
    return rejected.select("id", reports.REJECT)


@query
def report_freshness(spark, d):
    now = wall_clock("2001-07-30 00:00:00")
    fresh = reports.fresh_status(view(spark, d, "spots"), view(spark, d, "reports"), now, ttl_minutes=60 * 24 * 30)
    return fresh.select("id", "status", "reported_at")


@query
def reports_per_blockface(spark, d):
    faces = view(spark, d, "faced_spots").where(F.col("blockface_id").isNotNull()).select(
        F.col("id").alias("parking_spot_id"), "blockface_id"
    )
    return reports.reports_per_blockface(view(spark, d, "reports"), faces, "1 day")


@query
def apply_change_feed(spark, d):
    state = changes.apply_changes(view(spark, d, "spots"), view(spark, d, "change_feed"))
    return state.select("id", "street_name", "status")


@query
def viewer_messages(spark, d):
    return viewers.viewer_messages(viewers.row_changes(view(spark, d, "moving_feed")), view(spark, d, "viewers"))


@query
def filtered_change_feed(spark, d):
    feed = changes.visible_changes(view(spark, d, "change_feed"), F.col("status") == "AVAILABLE")
    return changes.apply_changes(view(spark, d, "spots"), feed).select("id", "street_name", "status")


@query
def update_messages(spark, d):
    operations = view(spark, d, "spot_operations").select(
        "seq", "id",
        F.expr("CASE op WHEN 'create' THEN 'CREATE' WHEN 'update' THEN 'UPDATE' WHEN 'delete' THEN 'DELETE' ELSE 'AVAILABILITY_UPDATE' END").alias("update_type"),
    )
    spots = view(spark, d, "archive_spots")
    sent = changes.update_messages(operations, spots)
    return sent.select("update_type", "id", F.col("spot.address").alias("address"), F.col("spot.available").alias("available"))


def _checked_operations(spark, d) -> DataFrame:
    return spot_admin.check_operations(view(spark, d, "archive_spots"), view(spark, d, "spot_operations"))


@query
def spot_operations(spark, d):
    return spot_admin.apply_operations(view(spark, d, "archive_spots"), _checked_operations(spark, d))


@query
def spot_operation_rejects(spark, d):
    rejected = _checked_operations(spark, d).where(F.col("reject_reason").isNotNull())
    return rejected.select("seq", "op", "id", "reject_reason")


@query
def upsert_snapshot(spark, d):
    state = upsert(
        view(spark, d, "spots"), view(spark, d, "changed_spots"), ["id"], at=noon(), keep=["source"], with_change=True
    )
    return state.select("id", "street_name", "address", "status", "source", "updated_at", F.col("_change").alias("change"))


@query
def insert_absent_favorites(spark, d):
    adds = view(spark, d, "favorite_log").where("op = 'add'")
    taken = view(spark, d, "toggle_requests").select("user_id", "parking_spot_id").distinct()
    inserted, _ = insert_if_absent(taken, adds, ["user_id", "parking_spot_id"], ["ts", "seq"])
    return inserted


# --- integrity ------------------------------------------------------------


@query
def domain_violations(spark, d):
    rows = view(spark, d, "reports").withColumn("note", F.lit(None).cast("string"))
    _, rejected = integrity.split_by_rules(rows, schemas.RULES["parking_reports"])
    return rejected.select("id", F.concat_ws("; ", "violations").alias("violations"))


@query
def orphan_reports(spark, d):
    return integrity.orphans(view(spark, d, "reports"), view(spark, d, "spots"), "parking_spot_id", salt_by=["id"])


@query
def cascade_delete(spark, d):
    gone = view(spark, d, "spots").where("status = 'UNKNOWN'")
    return integrity.cascade_delete(view(spark, d, "reports"), gone, "parking_spot_id", salt_by=["id"])


@query
def set_null_on_delete(spark, d):
    gone = view(spark, d, "users").where(F.col("raw_user_meta_data") == "{}").select("id")
    events = view(spark, d, "analytics_events").select("id", "user_id", "event_name")
    return integrity.set_null_on_delete(events, gone, "user_id", salt_by=["id"])


@query
def unique_key_check(spark, d):
    cleaned = accounts.clean_signups(view(spark, d, "waitlist_raw"))
    mapped = _plan(spark, d).mapped_meters.where(F.col("skip_reason").isNull())
    return integrity.unique_report(
        {
            "parking_spots": (view(spark, d, "spots"), [["id"]]),
            "favorite_log": (view(spark, d, "favorite_log"), [["user_id", "parking_spot_id"]]),
            "waitlist_signups": (cleaned, [["email"]]),
            "city_parking_meters": (mapped, [["source_id", "external_id"]]),
        }
    )


@query
def declared_key_check(spark, d):
    """Every unique key of the schema, over each table; two of the tables are raw logs that break theirs."""
    plan = _plan(spark, d)
    log = view(spark, d, "favorite_log").withColumnRenamed("seq", "id")
    return integrity.declared_key_report(
        {
            "parking_spots": view(spark, d, "spots"),
            "parking_reports": view(spark, d, "reports"),
            "waitlist_signups": accounts.clean_signups(view(spark, d, "waitlist_raw")).withColumnRenamed("seq", "id"),
            "city_parking_sources": _sources(spark),
            "city_parking_blocks": plan.blocks,
            "city_parking_meters": plan.meter_rows,
            "normalized_parking_locations": plan.locations,
            "favorite_parking_spots": log,
            "analytics_events": view(spark, d, "analytics_events"),
            "profiles": accounts.signup_profiles(view(spark, d, "users")),
        }
    )


# --- curb rules -----------------------------------------------------------


@query
def spot_rules(spark, d):
    return rules.spot_rules(view(spark, d, "faced_spots"), view(spark, d, "curb_rules"))


def _detailed_rules(spark, d) -> DataFrame:
    return rules.detailed_rules(view(spark, d, "faced_spots"), view(spark, d, "curb_rules"))


@query
def strictest_rules(spark, d):
    found = rules.strictest_rule(_detailed_rules(spark, d), view(spark, d, "curb_rules"))
    return found.select("spot_id", "rule_id", "regulation_type", "priority")


@query
def strictest_rules_folded(spark, d):
    """The same rows as `strictest_rules`, from rules folded before they meet a spot."""
    spots, named = view(spark, d, "faced_spots"), view(spark, d, "curb_rules")
    found = strictest_rule_of_spots(spots, named).drop("priority")
    return rules.with_rule(found, named).select("spot_id", "rule_id", "regulation_type", "priority")


@query
def sweeping_windows(spark, d):
    now = wall_clock("2024-01-29 09:15:00")
    return rules.sweeping_status(view(spark, d, "sweeping_rules"), now).select("id", "in_force", "next_start")


@query
def parking_allowed(spark, d):
    now = wall_clock("2024-01-15 09:15:00")
    return rules.allowed_now(
        view(spark, d, "faced_spots"), _detailed_rules(spark, d), view(spark, d, "sweeping_rules"), now
    )


@query
def zone_of_spot(spark, d):
    zones = rules.with_rings(view(spark, d, "zones"))
    return rules.zones_of_points(view(spark, d, "faced_spots"), zones)


@query
def zone_by_code(spark, d):
    return rules.zones_by_code(view(spark, d, "faced_spots"), view(spark, d, "zones"))


@query
def spot_context(spark, d):
    now = wall_clock("2024-01-15 09:15:00")
    return rules.spot_context(
        view(spark, d, "faced_spots"), view(spark, d, "curb_rules"), view(spark, d, "sweeping_rules"),
        rules.with_rings(view(spark, d, "zones")), now,
    )


# --- streams, run to the end of the given files ---------------------------


def _stream(spark, d, table: str) -> DataFrame:
    """The table's file as a stream, under the name the batch views use."""
    schema = spark.read.parquet(f"{d}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/{table}*.parquet")


@query
def stream_change_feed(spark, d):
    feed = _stream(spark, d, "events").select(
        F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("id"),
        F.expr("CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END").alias("op"),
        F.expr("CASE event_id % 3 WHEN 0 THEN 'AVAILABLE' WHEN 1 THEN 'OCCUPIED' ELSE 'UNKNOWN' END").alias("status"),
    )
    out = shared_dir(spark, "change-feed")
    jobs.change_feed_writer(feed, f"{out}/batches", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return jobs.current_spots(spark, view(spark, d, "spots"), f"{out}/batches").select("id", "street_name", "status")


def _stream_view(spark, d, name: str, table: str) -> DataFrame:
    """A view of one table, over that table as a stream."""
    source = f"stream_of_{table}"
    _stream(spark, d, table).createOrReplaceTempView(source)
    return without_zone(spark.sql(VIEWS[name].format(**{table: source})))


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@query
def stream_viewer_messages(spark, d):
    out, before = shared_dir(spark, "viewers"), spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        feed = _stream_view(spark, d, "moving_feed", "events")
        writer = viewer_writer(feed, view(spark, d, "viewers"), f"{out}/batches", f"{out}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STATE_STORE, before)
    return read_batches(spark, f"{out}/batches").drop("batch_id")


def _run_report_stream(spark, d) -> str:
    incoming = _stream(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.expr("CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderkey % 150 END").alias("user_id"),
        F.expr("CASE WHEN o_orderkey % 89 = 0 THEN -1 ELSE o_custkey END").alias("parking_spot_id"),
        F.expr("CASE WHEN o_orderkey % 83 = 0 THEN 'TAKEN' WHEN o_orderstatus = 'F' THEN 'AVAILABLE' "
               "WHEN o_orderstatus = 'O' THEN 'OCCUPIED' ELSE 'UNKNOWN' END").alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )
    out = shared_dir(spark, "reports")
    writer = jobs.report_writer(
        incoming, f"{out}/batches", f"{out}/checkpoint", spots=view(spark, d, "spots"), checked=f"{out}/checked"
    )
    writer.trigger(availableNow=True).start().awaitTermination()
    return out


@query
def stream_reports(spark, d):
    out = _run_report_stream(spark, d)
    return jobs.spots_with_reports(spark, view(spark, d, "spots"), f"{out}/batches").select(SPOT)


@query
def stream_accepted_reports(spark, d):
    accepted, _ = jobs.stored_reports(spark, f"{_run_report_stream(spark, d)}/checked")
    return accepted


@query
def stream_rejected_reports(spark, d):
    _, rejected = jobs.stored_reports(spark, f"{_run_report_stream(spark, d)}/checked")
    return rejected.select("id", reports.REJECT)


@query
def stream_report_freshness(spark, d):
    now = wall_clock("2001-08-02 00:00:00")
    out = _run_report_stream(spark, d)
    fresh = jobs.fresh_spots(spark, view(spark, d, "spots"), f"{out}/batches", now, ttl_minutes=60 * 24 * 30)
    return fresh.select("id", "status", "reported_at")


@query
def stream_events(spark, d):
    incoming = _stream(spark, d, "events").select(
        F.col("event_id").alias("id"), F.expr("CASE WHEN event_id % 17 = 0 THEN NULL ELSE user_id END").alias("user_id"),
        F.col("event_type").alias("event_name"), F.col("props").alias("event_payload"), F.col("ts").alias("created_at"),
    )
    out = shared_dir(spark, "events")
    jobs.event_writer(incoming, f"{out}/log", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    stored = spark.read.parquet(f"{out}/log")
    return stored.select(
        "id", "user_id", "event_name", F.get_json_object("event_payload", "$.k").alias("k"), "created_at", "event_date"
    )


@query
def stream_reports_per_blockface(spark, d):
    out = shared_dir(spark, "blockfaces")
    faces = view(spark, d, "faced_spots").where(F.col("blockface_id").isNotNull()).select(
        F.col("id").alias("parking_spot_id"), "blockface_id"
    )
    incoming = _stream_view(spark, d, "reports", "orders")
    writer = blockfaces.blockface_writer(incoming, faces, f"{out}/batches", f"{out}/checkpoint", "1 day", "30 days")
    writer.trigger(availableNow=True).start().awaitTermination()
    return blockfaces.blockface_windows(spark, f"{out}/batches", "1 day", "30 days")
