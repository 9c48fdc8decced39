"""SQL that must give the same rows as the registered queries."""

from __future__ import annotations

from fixtures import duckdb_view

ORACLES: dict[str, str] = {}

POINT = (37.7879, -122.4075)
FAR = (40.7128, -74.0060)


def with_views(views: str, body: str, **ctes: str) -> str:
    parts = [f"{v} AS ({duckdb_view(v)})" for v in views.split()]
    parts += [f"{name} AS ({text})" for name, text in ctes.items()]
    return f"WITH {', '.join(parts)} {body}"


def oracle(name: str, views: str, body: str, **ctes: str) -> None:
    ORACLES[name] = with_views(views, body, **ctes)


def haversine(lat1, lng1, lat2: str = "latitude", lng2: str = "longitude") -> str:
    def rad(x) -> str:
        return f"(({x}) * pi() / 180)"

    a = (
        f"(power(sin(({rad(f'{lat2} - ({lat1})')}) / 2), 2) + cos({rad(lat1)}) * cos({rad(lat2)})"
        f" * power(sin(({rad(f'{lng2} - ({lng1})')}) / 2), 2))"
    )
    return f"(6371 * (2 * atan2(sqrt({a}), sqrt(1 - {a}))) / 1.609344)"


def box(lat: float, lng: float, meters: float) -> str:
    off = meters / 111000
    return (
        f"latitude BETWEEN {lat - off!r} AND {lat + off!r} AND longitude BETWEEN {lng - off!r} AND {lng + off!r}"
    )


SPOT = "id, street_name, address, status, parking_type, updated_at"
DIST = haversine(*POINT)
MILES = 0.5

# --- spot lists -----------------------------------------------------------

oracle(
    "nearby_spots", "spots",
    f"SELECT id, street_name, round({DIST}, 6) AS distance_miles FROM spots"
    f" WHERE {box(*POINT, MILES * 1609.344)} AND {DIST} <= {MILES} ORDER BY {DIST}, id LIMIT 100",
)
oracle(
    "nearby_spots_unclipped", "spots",
    f"SELECT id, street_name, round({DIST}, 6) AS distance_miles FROM spots WHERE {DIST} <= {MILES} ORDER BY {DIST}, id LIMIT 100",
)
oracle(
    "radius_leak_check", "spots",
    f"SELECT count(*) AS leaks FROM spots WHERE {DIST} <= {MILES} AND {DIST} > {MILES} + 1e-6",
)
oracle("latest_spots", "spots", f"SELECT {SPOT} FROM spots ORDER BY updated_at DESC, id LIMIT 10")
IN_BOX = f"SELECT {SPOT} FROM spots WHERE {box(*POINT, 2000)} ORDER BY updated_at DESC, id LIMIT 100"
oracle("spots_in_box", "spots", IN_BOX)
oracle("visible_spot_count", "spots", f"SELECT count(*) AS row_count FROM ({IN_BOX}) t")


def fallback(point) -> tuple[str, dict]:
    near = f"SELECT {SPOT} FROM spots WHERE {box(*point, 2000)} ORDER BY updated_at DESC, id LIMIT 100"
    late = f"SELECT {SPOT} FROM spots ORDER BY updated_at DESC, id LIMIT 50"
    body = (
        "SELECT *, false AS is_fallback FROM near UNION ALL"
        " SELECT *, true AS is_fallback FROM late WHERE NOT EXISTS (SELECT 1 FROM near)"
    )
    return body, {"near": near, "late": late}


for _name, _point in (("nearby_with_fallback", FAR), ("nearby_without_fallback", POINT)):
    _body, _ctes = fallback(_point)
    oracle(_name, "spots", _body, **_ctes)

oracle(
    "spot_search", "spots",
    f"SELECT {SPOT} FROM spots WHERE contains(lower(street_name), 'build') OR coalesce(contains(lower(address), 'build'), false)",
)
oracle(
    "spots_by_chip", "spots",
    "SELECT 'ALL' AS chip, id FROM spots UNION ALL SELECT status, id FROM spots WHERE status <> 'UNKNOWN'"
    " UNION ALL SELECT parking_type, id FROM spots WHERE parking_type IN ('METERED', 'FREE')",
)
_CARDS = """SELECT id,
  CASE status WHEN 'AVAILABLE' THEN 'Available' WHEN 'OCCUPIED' THEN 'Occupied' ELSE 'Unknown' END AS status_label,
  CASE parking_type WHEN 'METERED' THEN 'Metered' WHEN 'FREE' THEN 'Free' WHEN 'LOADING_ZONE' THEN 'Loading Zone'
    WHEN 'STREET_SWEEPING' THEN 'Street Sweeping' WHEN 'GARAGE' THEN 'Garage' ELSE 'Unknown' END AS type_label,
  CASE status WHEN 'AVAILABLE' THEN '#22c55e' WHEN 'OCCUPIED' THEN '#ef4444' ELSE '#a3a3a3' END AS marker_color,
  CASE status WHEN 'AVAILABLE' THEN 'green' WHEN 'OCCUPIED' THEN 'red' ELSE 'gray' END AS pin_color,
  CASE WHEN starts_with(price, '$') THEN price ELSE '$' || price END AS display_price,
  CASE WHEN m < 1 THEN 'Just now' WHEN m < 60 THEN m || ' min ago' WHEN m < 1440 THEN floor(m / 60)::BIGINT || ' hr ago'
    ELSE strftime(updated_at, '%b %-d, %Y') END AS updated_label,
  CASE WHEN m < 1 THEN 'Just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN floor(m / 60)::BIGINT || 'h ago'
    ELSE floor(m / 1440)::BIGINT || 'd ago' END AS time_ago
FROM aged"""
oracle(
    "spot_cards", "spots", _CARDS,
    aged="SELECT *, CAST(floor((epoch_ms(TIMESTAMP '2024-01-28 18:30:00') - epoch_ms(updated_at)) / 60000) AS BIGINT) AS m FROM spots",
)
oracle("spot_by_id", "spots", f"SELECT {SPOT} FROM spots WHERE id = 42")
oracle(
    "available_search", "archive_spots",
    "SELECT * FROM archive_spots WHERE available AND contains(lower(address), 'auto')",
)
oracle(
    "available_nearby", "archive_spots",
    f"SELECT id, address, price, round({DIST}, 6) AS distance_miles FROM archive_spots"
    f" WHERE available AND {DIST} <= 1000 / 1609.344e0",
)
oracle(
    "nearest_available", "archive_spots",
    f"SELECT id, round({DIST}, 6) AS distance_miles FROM archive_spots WHERE available AND {DIST} <= 1.0"
    f" ORDER BY {DIST}, id LIMIT 100",
)
oracle(
    "dashboard_first_six", "archive_spots",
    f"SELECT id, address, available, round({DIST}, 6) AS distance_miles FROM archive_spots"
    f" WHERE {DIST} <= 2000 / 1609.344e0 ORDER BY id LIMIT 6",
)
oracle("dashboard_first_available", "archive_spots", "SELECT * FROM archive_spots WHERE available ORDER BY id LIMIT 6")
oracle(
    "radius_join_pairs", "spots points",
    f"SELECT point_id, id, round(distance, 6) AS distance_miles FROM pairs WHERE distance <= {MILES}",
    pairs=f"SELECT point_id, id, {haversine('point_latitude', 'point_longitude')} AS distance FROM points, spots",
)

oracle(
    "nearest_per_point", "spots points",
    f"""SELECT point_id, id, round(distance, 6) AS distance_miles, nearness FROM (SELECT *, CAST(row_number() OVER
  (PARTITION BY point_id ORDER BY distance, id) AS INTEGER) AS nearness FROM pairs WHERE distance <= {MILES}) t WHERE nearness <= 3""",
    pairs=f"SELECT point_id, id, {haversine('point_latitude', 'point_longitude')} AS distance FROM points, spots",
)

oracle(
    "nearest_k_any_distance", "spots world_points",
    f"""SELECT point_id, id, round(distance, 6) AS distance_miles, nearness FROM (SELECT *, CAST(row_number() OVER
  (PARTITION BY point_id ORDER BY distance, id) AS INTEGER) AS nearness FROM pairs) t WHERE nearness <= 3""",
    pairs=f"SELECT point_id, id, {haversine('point_latitude', 'point_longitude')} AS distance FROM world_points, spots"
    " WHERE point_latitude BETWEEN -90 AND 90 AND point_longitude BETWEEN -180 AND 180",
)

# --- favorites, users, events ---------------------------------------------


# The first add after a pair's last remove; a remove opens a new run.
FAVORITES = (
    "SELECT user_id, parking_spot_id, ts AS created_at, seq FROM (SELECT *, row_number() OVER"
    " (PARTITION BY user_id, parking_spot_id ORDER BY ts, seq) AS nth FROM (SELECT *, sum(CASE WHEN op = 'remove' THEN 1 ELSE 0 END)"
    " OVER (PARTITION BY user_id, parking_spot_id ORDER BY ts DESC, seq DESC ROWS UNBOUNDED PRECEDING) AS removes_ahead"
    " FROM favorite_log) r WHERE op = 'add' AND removes_ahead = 0) s WHERE nth = 1"
)
oracle("favorites_current", "favorite_log", FAVORITES)
oracle(
    "favorites_after_toggles", "favorite_log toggle_requests",
    "SELECT coalesce(f.user_id, n.user_id) AS user_id, coalesce(f.parking_spot_id, n.parking_spot_id) AS parking_spot_id"
    " FROM fav f FULL JOIN n ON f.user_id = n.user_id AND f.parking_spot_id = n.parking_spot_id"
    " WHERE (CASE WHEN f.user_id IS NULL THEN 0 ELSE 1 END + coalesce(n.n, 0)) % 2 = 1",
    fav=FAVORITES,
    n="SELECT user_id, parking_spot_id, count(*) AS n FROM toggle_requests GROUP BY ALL",
)
oracle("my_favorites", "favorite_log", "SELECT * FROM fav WHERE user_id = 7", fav=FAVORITES)
oracle(
    "is_favorite", "favorite_log",
    "SELECT count(*) > 0 AS is_favorite FROM fav WHERE user_id = 7 AND parking_spot_id = 8", fav=FAVORITES,
)
oracle(
    "favorite_spots", "favorite_log spots",
    f"SELECT {SPOT} FROM spots WHERE id IN (SELECT parking_spot_id FROM fav WHERE user_id = 7)", fav=FAVORITES,
)
oracle(
    "favorites_with_spot", "favorite_log spots",
    "SELECT user_id, parking_spot_id, created_at, street_name, status FROM fav JOIN spots ON id = parking_spot_id",
    fav=FAVORITES,
)
oracle("favorite_ids", "favorite_log", "SELECT DISTINCT parking_spot_id FROM fav", fav=FAVORITES)
oracle(
    "dashboard_stats", "archive_spots favorite_log",
    "SELECT (SELECT count(*) FROM archive_spots) AS total_spots, (SELECT count(*) FROM archive_spots WHERE available) AS available_spots,"
    " (SELECT count(*) FROM fav WHERE user_id = 7) AS favorite_spots, CAST(0 AS BIGINT) AS recent_searches",
    fav=FAVORITES,
)
oracle(
    "user_activity_counts", "favorite_log reports",
    "SELECT user_id, coalesce(f, 0) AS favorites, coalesce(r, 0) AS reports FROM"
    " (SELECT user_id, count(*) AS f FROM fav GROUP BY 1) a FULL JOIN"
    " (SELECT user_id, count(*) AS r FROM reports WHERE user_id IS NOT NULL GROUP BY 1) b USING (user_id)",
    fav=FAVORITES,
)
oracle("own_report_count", "reports", "SELECT count(*) AS row_count FROM reports WHERE user_id = 7")
oracle("own_reports", "reports", "SELECT * FROM reports WHERE user_id = 7")
oracle(
    "event_rights", "analytics_events",
    "SELECT id, user_id, user_id IS NULL OR user_id = 7 AS allowed FROM analytics_events",
)
oracle("report_rights", "reports", "SELECT id, user_id, coalesce(user_id = 7, false) AS allowed FROM reports")
oracle(
    "event_rollup", "analytics_events",
    "SELECT event_name, CAST(created_at AS DATE) AS event_date, count(*) AS events, count(user_id) AS identified_events,"
    " count(DISTINCT user_id) AS users FROM analytics_events GROUP BY ALL",
)
oracle(
    "event_payload_keys", "analytics_events",
    "SELECT id, unnest(json_keys(event_payload)) AS payload_key, event_payload->>'$.k' AS k FROM analytics_events",
)
oracle(
    "sanitized_payloads", "wide_payloads",
    """SELECT id, '{"z":' || CAST(id AS VARCHAR) || ',"name":"' || (event_payload->>'$.name') || '","gone":null,"ok":'
  || (event_payload->>'$.ok') || ',"k1":1,"k2":2,"k3":3,"k4":4,"k5":5,"k6":6}' AS event_payload FROM wide_payloads""",
)
_SIGNUPS = (
    "SELECT seq, lower(trim(email)) AS email, nullif(trim(full_name), '') AS full_name, nullif(trim(interest), '') AS interest,"
    " contains(email, '@') AND length(trim(email)) <= 254 AS is_valid FROM waitlist_raw"
)
_RANKED = (
    "SELECT *, row_number() OVER (PARTITION BY email ORDER BY seq) AS nth,"
    " email IN (SELECT 'user' || id || '@example.com' FROM zones) AS taken FROM signups WHERE is_valid"
)
oracle(
    "waitlist_accepted", "waitlist_raw zones",
    "SELECT seq, email, full_name, interest FROM ranked WHERE nth = 1 AND NOT taken", signups=_SIGNUPS, ranked=_RANKED,
)
oracle(
    "waitlist_already", "waitlist_raw zones",
    "SELECT seq, email FROM ranked WHERE nth > 1 OR taken", signups=_SIGNUPS, ranked=_RANKED,
)
oracle(
    "waitlist_invalid", "waitlist_raw",
    "SELECT seq, email, full_name, interest FROM signups WHERE NOT is_valid", signups=_SIGNUPS,
)
oracle(
    "profiles_from_signups", "users points",
    "SELECT id, raw_user_meta_data->>'$.full_name' AS full_name, email, created_at FROM users"
    " WHERE id NOT IN (SELECT point_id FROM points)",
)
_UPDATES = (
    "SELECT *, CASE WHEN caller_id <> id THEN 'not_own_profile' WHEN trim(full_name) = '' THEN 'full_name_required'"
    " WHEN length(full_name) NOT BETWEEN 2 AND 100 THEN 'full_name_length' END AS reject_reason FROM profile_updates"
)
oracle(
    "profile_updates", "users profile_updates",
    "SELECT u.id, CASE WHEN l.id IS NULL THEN u.raw_user_meta_data->>'$.full_name' ELSE l.full_name END AS full_name, email,"
    " created_at, CASE WHEN l.id IS NULL THEN created_at ELSE TIMESTAMP '2024-01-30 12:00:00' END AS updated_at"
    " FROM users u LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS nth"
    " FROM checked WHERE reject_reason IS NULL) x WHERE nth = 1) l ON l.id = u.id",
    checked=_UPDATES,
)
oracle(
    "profile_update_rejects", "profile_updates",
    "SELECT seq, reject_reason FROM checked WHERE reject_reason IS NOT NULL", checked=_UPDATES,
)

# --- city feeds -----------------------------------------------------------


def text(*keys: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(trim(raw->>'$.{k}'), '')" for k in keys) + ", NULL)"


def number(*keys: str) -> str:
    return "coalesce(" + ", ".join(f"try_cast(trim(raw->>'$.{k}') AS DOUBLE)" for k in keys) + ", NULL)"


def nested(path: str) -> str:
    return f"CASE WHEN json_type(raw, '$.{path}') IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN CAST(raw->>'$.{path}' AS DOUBLE) END"


_STREET, _NUMBER = text("street_name", "streetname", "street"), text("street_num", "streetnum", "street_number")
_PICKED = f"""SELECT feed_pos, raw,
  {number('latitude', 'lat', 'y')} AS lat, {number('longitude', 'lng', 'long', 'x')} AS lng,
  coalesce({number('latitude', 'lat')}, {number('longitude', 'lng', 'long')}) IS NOT NULL AS has_plain,
  coalesce({text('post_id', 'postid', 'meter_id', 'meterid')}, {text('objectid', 'object_id', 'id')}) AS external_id,
  coalesce({text('post_id', 'postid')}, {text('post_id', 'postid', 'meter_id', 'meterid')}, {text('objectid', 'object_id', 'id')}) AS post_id,
  {text('blockface_id', 'blockface')} AS blockface_id,
  coalesce({text('street_name', 'streetname')}, CASE WHEN {_NUMBER} IS NOT NULL AND {_STREET} IS NOT NULL
    THEN {_NUMBER} || ' ' || {_STREET} ELSE {_STREET} END) AS street_name,
  {_NUMBER} AS street_num, {text('cap_color', 'capcolor')} AS cap_color,
  {text('active_meter_flag', 'active_meter', 'active', 'status')} AS active_meter_flag
FROM meter_feed"""
_MAPPED = f"""SELECT *, CASE WHEN good AND external_id IS NOT NULL THEN NULL WHEN good THEN 'missing_meter_id'
    WHEN has_plain THEN 'invalid_coordinates' ELSE 'missing_coordinates' END AS skip_reason
FROM (SELECT *, coalesce(latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180, false) AS good
  FROM (SELECT * EXCLUDE (lat, lng),
      coalesce(CASE WHEN (lat IS NULL OR lng IS NULL) AND json_array_length(raw, '$.shape.coordinates') = 2
        THEN {nested('shape.coordinates[1]')} ELSE lat END, {nested('location.latitude')}) AS latitude,
      coalesce(CASE WHEN (lat IS NULL OR lng IS NULL) AND json_array_length(raw, '$.shape.coordinates') = 2
        THEN {nested('shape.coordinates[0]')} ELSE lng END, {nested('location.longitude')}) AS longitude
    FROM picked) c) g"""
_METERS = (
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY external_id ORDER BY feed_pos DESC) AS nth FROM mapped"
    " WHERE skip_reason IS NULL) r WHERE nth = 1"
)
FEED = {"picked": _PICKED, "mapped": _MAPPED}
METERS = {**FEED, "meters": _METERS}
METER = "external_id, post_id, blockface_id, street_name, street_num, latitude, longitude, cap_color, active_meter_flag"
AT = "TIMESTAMP '2024-02-01 00:00:00'"

oracle("meter_ingest", "meter_feed", f"SELECT feed_pos, {METER} FROM mapped WHERE skip_reason IS NULL", **FEED)
oracle(
    "meter_rejects", "meter_feed",
    "SELECT feed_pos, skip_reason, raw AS raw_payload FROM mapped WHERE skip_reason IS NOT NULL", **FEED,
)
_COUNTS = (
    "SELECT count(*) AS fetched, count(skip_reason) AS skipped, count(*) - count(skip_reason) AS ready,"
    " count(*) FILTER (skip_reason = 'missing_coordinates') AS skipped_missing_coordinates,"
    " count(*) FILTER (skip_reason = 'missing_meter_id') AS skipped_missing_meter_id,"
    " count(*) FILTER (skip_reason = 'invalid_coordinates') AS skipped_invalid_coordinates FROM "
)
oracle("meter_skip_counts", "meter_feed", _COUNTS + "mapped", **FEED)
oracle(
    "limited_meter_counts", "meter_feed",
    _COUNTS + "(SELECT * FROM mapped ORDER BY feed_pos LIMIT 100) t", **FEED,
)
_BLOCKS = (
    "SELECT raw->>'$.objectid' AS external_id, raw->>'$.blockface_id' AS blockface_id, raw->>'$.street' AS street_name,"
    " CAST(raw->>'$.num_spaces' AS INTEGER) AS spaces_count FROM block_feed"
)
oracle(
    "meters_with_blocks", "meter_feed block_feed",
    "SELECT m.external_id, m.blockface_id, b.external_id AS block_external_id FROM meters m LEFT JOIN blocks b USING (blockface_id)",
    **METERS, blocks=_BLOCKS,
)
oracle(
    "block_ingest", "block_feed",
    f"SELECT *, CAST(NULL AS DOUBLE) AS latitude, {AT} AS imported_at FROM blocks", blocks=_BLOCKS,
)
_REGS = (
    "SELECT feed_pos, raw->>'$.blockface' AS blockface_id, raw->>'$.regulation' AS regulation_type, raw->>'$.agency' AS agency,"
    " raw->>'$.days' AS days_of_week, CAST(raw->>'$.hrlimit' AS INTEGER) AS hour_limit FROM regulation_feed"
)
oracle(
    "regulation_merge", "block_feed regulation_feed",
    "SELECT b.*, regulation_type, agency, days_of_week, hour_limit,"
    f" {AT} AS imported_at FROM blocks b LEFT JOIN (SELECT * EXCLUDE (nth, feed_pos) FROM (SELECT *, row_number() OVER"
    " (PARTITION BY blockface_id ORDER BY feed_pos DESC) AS nth FROM regs) r WHERE nth = 1) l USING (blockface_id)",
    blocks=_BLOCKS, regs=_REGS,
)
oracle(
    "regulation_match_counts", "block_feed regulation_feed",
    "SELECT count(b.blockface_id) AS matched, count(*) - count(b.blockface_id) AS unmatched"
    " FROM regs LEFT JOIN blocks b USING (blockface_id)",
    blocks=_BLOCKS, regs=_REGS,
)
_LINE = "nullif(trim(concat_ws(' ', street_num, street_name)), '')"
oracle(
    "meters_clean", "meter_feed",
    f"SELECT coalesce(post_id, external_id) AS meter_id, active_meter_flag AS status, latitude, longitude,"
    f" {_LINE} AS location_description, {AT} AS last_ingested_at, 'Parking Meters' AS source_name,"
    " 'datasf_parking_meters' AS source_key, '8vzz-qzz9' AS source_dataset_id, blockface_id, cap_color FROM meters",
    **METERS,
)
oracle(
    "meters_embedded_source", "meter_feed",
    "SELECT external_id, 'DATASF' AS provider, 'Parking Meters' AS display_name FROM meters", **METERS,
)
oracle(
    "missing_locations", "meter_feed",
    f"SELECT coalesce(post_id, external_id) AS meter_id FROM meters WHERE {_LINE} IS NULL", **METERS,
)
_LOCATIONS = f"""SELECT 'datasf_parking_meter' AS source_type, post_id AS source_id, latitude, longitude,
  CASE WHEN street_name IS NOT NULL THEN concat_ws(' ', street_num, street_name) || ', San Francisco, CA' END AS address,
  'METERED' AS parking_type, CAST(NULL AS VARCHAR) AS time_limit,
  coalesce(upper(active_meter_flag) NOT IN ('N', 'NO', 'INACTIVE', '0', 'FALSE', 'F'), true) AS active,
  'cap_color:' || cap_color AS restrictions, 'San Francisco' AS city, {AT} AS last_synced_at FROM meters"""
LOCATIONS = {**METERS, "locations": _LOCATIONS}
oracle("normalized_locations", "meter_feed", "SELECT * FROM locations", **LOCATIONS)
oracle(
    "location_provenance", "meter_feed",
    "SELECT post_id AS source_id, 'city_parking_meters' AS city_table, external_id, post_id, blockface_id,"
    " 'datasf_parking_meters' AS source_key, '8vzz-qzz9' AS dataset_id, 'Parking Meters' AS source_display_name,"
    " 'DATASF' AS provider, '2024-02-01T00:00:00Z' AS imported_at FROM meters",
    **METERS,
)
oracle(
    "normalize_counts", "meter_feed",
    "SELECT count(*) AS fetched, CAST(0 AS BIGINT) AS skipped, count(*) AS ready, CAST(0 AS BIGINT) AS skipped_invalid_coordinates,"
    " CAST(0 AS BIGINT) AS skipped_missing_source_id FROM meters",
    **METERS,
)
oracle(
    "typed_locations", "meter_feed",
    "SELECT source_id, latitude, address, active, last_synced_at, 'DATASF' AS provider FROM locations", **LOCATIONS,
)
_CITY_DIST = haversine(37.715, -122.415)
oracle(
    "city_nearby", "meter_feed",
    f"SELECT source_id, round({_CITY_DIST}, 6) AS distance_miles FROM locations WHERE {box(37.715, -122.415, 1609.344)}"
    f" AND {_CITY_DIST} <= 1.0 ORDER BY {_CITY_DIST}, source_id LIMIT 100",
    **LOCATIONS,
)
oracle(
    "city_newest", "meter_feed",
    "SELECT * FROM locations WHERE city ILIKE 'san fran%' ORDER BY last_synced_at DESC, source_id LIMIT 500", **LOCATIONS,
)
oracle(
    "city_active", "meter_feed",
    "SELECT * FROM locations WHERE active ORDER BY last_synced_at DESC, source_id LIMIT 500", **LOCATIONS,
)
_ZERO = "CAST(0 AS BIGINT)"
oracle(
    "quality_report", "meter_feed",
    f"SELECT count(*) AS row_count, {_ZERO} AS invalid_coordinates, {_ZERO} AS missing_last_synced, {_ZERO} AS missing_raw_source,"
    f" {_ZERO} AS missing_active, {_ZERO} AS duplicate_keys, true AS passed FROM locations",
    **LOCATIONS,
)
oracle(
    "unfiltered_quality_report", "meter_feed",
    f"SELECT count(*) AS row_count, count(*) FILTER (NOT good) AS invalid_coordinates, {_ZERO} AS missing_last_synced,"
    f" {_ZERO} AS missing_raw_source, {_ZERO} AS missing_active,"
    " (SELECT count(*) FROM (SELECT post_id FROM mapped GROUP BY 1 HAVING count(*) > 1) k) AS duplicate_keys, false AS passed FROM mapped",
    **FEED,
)
oracle(
    "clean_view_report", "meter_feed",
    f"SELECT count(*) AS row_count, {AT} AS latest_ingested_at, count(*) FILTER (NOT good) AS invalid_coordinates FROM meters",
    **METERS,
)
oracle(
    "newest_valid_meters", "meter_feed",
    f"SELECT coalesce(post_id, external_id) AS meter_id, active_meter_flag AS status, latitude, longitude,"
    f" {_LINE} AS location_description FROM meters ORDER BY 1 LIMIT 5",
    **METERS,
)
oracle(
    "newest_samples", "meter_feed",
    "SELECT source_type, source_id, active, address FROM locations ORDER BY last_synced_at DESC, source_type, source_id LIMIT 10",
    **LOCATIONS,
)
_DUPLICATES = "SELECT external_id, count(*) AS count FROM mapped WHERE skip_reason IS NULL GROUP BY 1 HAVING count(*) > 1"
oracle("duplicate_keys", "meter_feed", _DUPLICATES, **FEED)
oracle("duplicate_key_examples", "meter_feed", _DUPLICATES + " ORDER BY count(*) DESC, external_id LIMIT 5", **FEED)
oracle(
    "source_registry", "meter_feed block_feed regulation_feed",
    f"""SELECT 'datasf_metered_blocks' AS source_key, 'SFMTA Metered Street Blocks' AS display_name, '27b3-yjjx' AS dataset_id,
  {AT} AS last_imported_at, (SELECT count(*) FROM blocks) AS last_row_count, {AT} AS created_at, {AT} AS updated_at
UNION ALL SELECT 'datasf_parking_meters', 'Parking Meters', '8vzz-qzz9', {AT}, (SELECT count(*) FROM meters),
  TIMESTAMP '2023-01-01 00:00:00', {AT}
UNION ALL SELECT 'datasf_parking_regulations', 'Parking Regulations (blockface map)', 'hi6h-neyh', {AT},
  (SELECT count(*) FROM regs JOIN blocks USING (blockface_id)), {AT}, {AT}""",
    **METERS, blocks=_BLOCKS, regs=_REGS,
)
oracle(
    "import_audit", "meter_feed",
    "SELECT 'DATASF' AS source, '8vzz-qzz9' AS source_dataset, 'normalized_parking_locations' AS target_table, 'partial' AS status,"
    " (SELECT count(*) FROM mapped) AS rows_fetched, (SELECT count(*) FROM locations WHERE NOT active) AS rows_inserted,"
    " (SELECT count(*) FROM locations WHERE active) AS rows_updated,"
    f" (SELECT count(skip_reason) FROM mapped) AS rows_skipped, {_ZERO} AS rows_deleted",
    **LOCATIONS,
)

def edited(table: str, key: str, text: str, gone: str) -> str:
    return (
        f"SELECT {key} AS k, CASE WHEN {key} LIKE '%6' THEN 'Old' ELSE {text} END AS v FROM {table} WHERE {key} NOT LIKE '%4'"
        f" UNION ALL SELECT '{gone}' || {key}, {text} FROM {table} WHERE {key} LIKE '%8'"
    )


_PATCHES = (
    "SELECT external_id, regulation_type, agency, days_of_week, hour_limit FROM blocks JOIN (SELECT *, row_number() OVER"
    " (PARTITION BY blockface_id ORDER BY feed_pos DESC) AS nth FROM regs) r USING (blockface_id) WHERE nth = 1"
)
_RUN = {
    **METERS, "blocks": _BLOCKS, "regs": _REGS, "locations": _LOCATIONS, "patches": _PATCHES,
    "new_rows": "SELECT 'blocks' AS t, external_id AS k, street_name AS v FROM blocks"
    " UNION ALL SELECT 'meters', external_id, street_name FROM meters"
    " UNION ALL SELECT 'regulations', external_id, CAST(hour_limit AS VARCHAR) FROM patches"
    # Meters that are gone from the feed stay in the table, so that locations are still made of them.
    " UNION ALL SELECT 'locations', source_id, address FROM locations"
    " UNION ALL SELECT 'locations', 'X' || source_id, address FROM locations WHERE source_id LIKE '%8'",
    "old_rows": f"SELECT 'blocks' AS t, * FROM ({edited('blocks', 'external_id', 'street_name', 'X')}) b"
    f" UNION ALL SELECT 'meters', * FROM ({edited('meters', 'external_id', 'street_name', 'X')}) m"
    f" UNION ALL SELECT 'locations', * FROM ({edited('locations', 'source_id', 'address', 'Y')}) l"
    " UNION ALL SELECT 'regulations', external_id, CASE WHEN external_id LIKE '%2' THEN '99' ELSE CAST(hour_limit AS VARCHAR) END"
    " FROM patches WHERE external_id NOT LIKE '%4' AND external_id NOT LIKE '%3'"
    " UNION ALL SELECT 'regulations', 'X' || external_id, CAST(hour_limit AS VARCHAR) FROM patches WHERE external_id LIKE '%8'",
    "changes": "SELECT coalesce(n.t, o.t) AS target, coalesce(n.k, o.k) AS key, CASE WHEN o.t IS NULL THEN 'inserted'"
    " WHEN n.t IS NULL THEN 'deleted' WHEN n.v IS NOT DISTINCT FROM o.v THEN 'unchanged' ELSE 'changed' END AS change"
    " FROM new_rows n FULL JOIN old_rows o ON n.t = o.t AND n.k = o.k",
    "fetched": "SELECT 'blocks' AS target, '27b3-yjjx' AS source_dataset, 'city_parking_blocks' AS target_table,"
    " count(*) AS n, 0 AS skipped FROM block_feed UNION ALL SELECT 'meters', '8vzz-qzz9', 'city_parking_meters', count(*),"
    " count(skip_reason) FROM mapped UNION ALL SELECT 'regulations', 'hi6h-neyh', 'city_parking_blocks', count(*),"
    " count(*) - count(b.blockface_id) FROM regs LEFT JOIN blocks b USING (blockface_id)"
    " UNION ALL SELECT 'locations', '8vzz-qzz9', 'normalized_parking_locations', count(*) + count(*) FILTER (external_id LIKE '%8'), 0"
    " FROM meters",
}
_LOG = (
    "SELECT 'DATASF' AS source, source_dataset, target_table, CASE WHEN skipped > 0 THEN 'partial' ELSE 'success' END AS status,"
    " n AS rows_fetched, count(*) FILTER (change = 'inserted') AS rows_inserted, count(*) FILTER (change = 'changed') AS rows_updated,"
    " count(*) FILTER (change = 'unchanged') AS rows_unchanged, count(*) FILTER (change = 'deleted') AS rows_deleted,"
    f" CAST(skipped AS BIGINT) AS rows_skipped, {_ZERO} AS rows_repeated, CAST(NULL AS VARCHAR) AS error_message"
    " FROM fetched LEFT JOIN changes USING (target) {0} GROUP BY target, source_dataset, target_table, n, skipped"
)
RUN_VIEWS = "meter_feed block_feed regulation_feed"
oracle("import_run_log", RUN_VIEWS, _LOG.format(""), **_RUN)
oracle(
    "import_run_changes", RUN_VIEWS,
    "SELECT * FROM changes WHERE target IN ('meters', 'locations') AND change <> 'unchanged'", **_RUN,
)
oracle(
    "import_run_stopped", RUN_VIEWS,
    _LOG.format("WHERE target IN ('blocks', 'regulations')")
    + f" UNION ALL SELECT 'DATASF', '8vzz-qzz9', 'city_parking_meters', 'failed', count(*), {', '.join([_ZERO] * 6)},"
    " 'missing: jurisdiction; unexpected: ' FROM meter_feed",
    **_RUN,
)
oracle(
    "landed_page_records", "meter_feed",
    "SELECT CAST(floor(feed_pos / 500) AS BIGINT) AS batch, row_number() OVER (PARTITION BY floor(feed_pos / 500) ORDER BY feed_pos)"
    " AS place, raw FROM meter_feed",
)
ORACLES["import_dry_run"] = ORACLES["meter_skip_counts"]
oracle("import_chosen_lines", RUN_VIEWS, _LOG.format("WHERE target IN ('meters', 'locations')"), **_RUN)
oracle(
    "seeded_spots", "spots",
    "SELECT street_name, address, latitude, CASE WHEN n % 29 <> 0 THEN longitude END AS longitude,"
    " CASE WHEN n % 13 = 0 THEN 'TAKEN' ELSE status END AS status, parking_type, price,"
    " n % 13 <> 0 AND n % 29 <> 0 AS accepted FROM (SELECT *, CAST(id AS BIGINT) AS n FROM spots) s",
)


def kinds(feed: str) -> str:
    return (
        "SELECT field, CASE t WHEN 'VARCHAR' THEN 'STRING' WHEN 'UBIGINT' THEN 'NUMBER' WHEN 'BIGINT' THEN 'NUMBER'"
        " WHEN 'DOUBLE' THEN 'NUMBER' ELSE t END AS kind FROM (SELECT field, json_type(raw, '$.\"' || field || '\"') AS t"
        f" FROM (SELECT raw, unnest(json_keys(raw)) AS field FROM {feed}) f) g"
    )


def summary(name: str) -> str:
    return (
        "SELECT field, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(*) AS records,"
        f" count(*) FILTER (kind <> 'NULL') AS filled FROM {name} GROUP BY 1"
    )


# Fixed in the fixture: one field holds an object with a list, one an object of numbers; each field has one shape.
oracle(
    "feed_shape", "meter_feed",
    "SELECT *, CAST(1 AS BIGINT) AS shapes, CASE field WHEN 'shape' THEN 2 WHEN 'location' THEN 1 ELSE 0 END AS depth FROM s",
    k=kinds("meter_feed"), s=summary("k"),
)
oracle(
    "feed_shape_drift", "meter_feed later_meter_feed",
    "SELECT * FROM (SELECT field, CASE WHEN n.kinds IS NULL THEN 'missing' WHEN b.kinds IS NULL THEN 'unexpected'"
    " WHEN n.kinds <> b.kinds THEN 'retyped' WHEN (b.filled - n.filled) / (SELECT count(*) FROM meter_feed) > 0.1 THEN 'sparser' END AS state,"
    " b.kinds AS kinds_before, n.kinds AS kinds_now FROM b FULL JOIN n USING (field)) d WHERE state IS NOT NULL",
    kb=kinds("meter_feed"), b=summary("kb"), kn=kinds("later_meter_feed"), n=summary("kn"),
)
oracle(
    "schema_drift", "meter_feed",
    "SELECT 'jurisdiction' AS missing_fields, count(DISTINCT field) AS unexpected_fields, string_agg(DISTINCT field, ',' ORDER BY field) AS unexpected_names,"
    " true AS drifted FROM (SELECT unnest(json_keys(raw)) AS field FROM meter_feed) f WHERE field = 'streetname'",
)
oracle(
    "schema_drift_fields", "meter_feed",
    "SELECT field, 'unexpected' AS state, count(*) AS records FROM (SELECT unnest(json_keys(raw)) AS field FROM meter_feed) f"
    " WHERE field = 'streetname' GROUP BY 1 UNION ALL SELECT 'jurisdiction', 'missing', 0",
)
oracle(
    "city_spot_projection", "spots meter_feed",
    f"""SELECT coalesce(o.source, l.source) AS source, coalesce(o.external_id, l.external_id) AS external_id,
  CASE WHEN l.external_id IS NOT NULL THEN l.street_name ELSE o.street_name END AS street_name,
  CASE WHEN l.external_id IS NOT NULL THEN l.address ELSE o.address END AS address, coalesce(o.status, 'UNKNOWN') AS status,
  CASE WHEN l.external_id IS NOT NULL THEN 'METERED' ELSE o.parking_type END AS parking_type,
  CASE WHEN l.external_id IS NOT NULL THEN {AT} ELSE o.updated_at END AS updated_at
FROM (SELECT *, 'P' || id AS external_id FROM spots) o FULL JOIN city l ON o.source = l.source AND o.external_id = l.external_id""",
    **METERS,
    city="SELECT 'DATASF' AS source, post_id AS external_id, coalesce(street_name, 'Unknown') AS street_name,"
    " CASE WHEN street_name IS NOT NULL THEN concat_ws(' ', street_num, street_name) || ', San Francisco, CA' END AS address FROM meters",
)

# --- changes --------------------------------------------------------------

_LATEST = (
    "SELECT parking_spot_id, status, created_at, id FROM (SELECT *, row_number() OVER"
    " (PARTITION BY parking_spot_id ORDER BY created_at DESC, id DESC) AS nth FROM reports"
    " WHERE user_id IS NOT NULL AND status IN ('AVAILABLE', 'OCCUPIED', 'UNKNOWN')) r WHERE nth = 1"
)
_APPLIED = (
    "SELECT s.id, street_name, address, coalesce(l.status, s.status) AS status, parking_type,"
    " coalesce(l.created_at, s.updated_at) AS updated_at FROM spots s LEFT JOIN latest l ON l.parking_spot_id = s.id"
)
oracle("latest_report_status", "reports", _LATEST)
oracle(
    "status_as_of", "reports status_probes",
    "SELECT probe_id, parking_spot_id, asked_at, coalesce(status, 'UNKNOWN') AS status, created_at AS reported_at FROM status_probes p"
    " LEFT JOIN last l USING (probe_id) ",
    last="SELECT p.probe_id, max_by(r.status, r.id) AS status, r.created_at FROM status_probes p JOIN reports r"
    " ON r.parking_spot_id = p.parking_spot_id AND r.created_at <= p.asked_at AND r.status IN ('AVAILABLE', 'OCCUPIED', 'UNKNOWN')"
    " WHERE r.created_at >= p.asked_at - INTERVAL 30 DAY GROUP BY p.probe_id, r.created_at"
    " QUALIFY row_number() OVER (PARTITION BY p.probe_id ORDER BY r.created_at DESC) = 1",
)
oracle("apply_reports", "spots reports", _APPLIED, latest=_LATEST)
_REASON = (
    "CASE WHEN user_id IS NULL THEN 'not_authenticated' WHEN status NOT IN ('AVAILABLE', 'OCCUPIED', 'UNKNOWN')"
    " THEN 'invalid_status' WHEN parking_spot_id NOT IN (SELECT id FROM spots) THEN 'spot_not_found' END"
)
oracle("accepted_reports", "spots reports", f"SELECT * FROM reports WHERE {_REASON} IS NULL")
oracle("rejected_reports", "spots reports", f"SELECT id, {_REASON} AS reject_reason FROM reports WHERE {_REASON} IS NOT NULL")
for _name, _since, _now in (
    ("report_freshness", "2001-06-30", "2001-07-30"),
    ("stream_report_freshness", "2001-07-03", "2001-08-02"),
):
    oracle(
        _name, "spots reports",
        "SELECT s.id, coalesce(l.status, 'UNKNOWN') AS status, l.created_at AS reported_at FROM spots s LEFT JOIN latest l"
        " ON l.parking_spot_id = s.id",
        latest="SELECT parking_spot_id, status, created_at FROM (SELECT *, row_number() OVER (PARTITION BY parking_spot_id"
        " ORDER BY created_at DESC, id DESC) AS nth FROM reports WHERE user_id IS NOT NULL AND status <> 'TAKEN'"
        f" AND created_at BETWEEN TIMESTAMP '{_since} 00:00:00' AND TIMESTAMP '{_now} 00:00:00') r WHERE nth = 1",
    )
oracle(
    "reports_per_blockface", "reports faced_spots",
    "SELECT blockface_id, date_trunc('day', created_at) AS window_start, status, count(*) AS reports, max(created_at) AS last_report_at"
    " FROM reports r JOIN faced_spots s ON s.id = r.parking_spot_id WHERE blockface_id IS NOT NULL GROUP BY ALL",
)


def change_state(feed: str) -> dict:
    """Last delete, first insert after it, then the latest counting event."""
    return {
        "ev": f"SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, seq) AS rn FROM {feed}",
        "cut": "SELECT id, coalesce(max(CASE WHEN op = 'DELETE' THEN rn END), 0) AS d FROM ev GROUP BY id",
        "born": "SELECT ev.id, min(rn) AS b FROM ev JOIN cut ON cut.id = ev.id WHERE op = 'INSERT' AND rn > d GROUP BY ev.id",
        "hit": "SELECT * FROM (SELECT ev.id, ev.status, row_number() OVER (PARTITION BY ev.id ORDER BY rn DESC) AS nth FROM ev"
        " JOIN cut ON cut.id = ev.id LEFT JOIN born ON born.id = ev.id LEFT JOIN spots s ON s.id = ev.id"
        " WHERE op <> 'DELETE' AND rn > d AND (rn >= b OR (d = 0 AND s.id IS NOT NULL))) h WHERE nth = 1",
    }


_STATE = (
    "SELECT hit.id, s.street_name, hit.status FROM hit LEFT JOIN spots s ON s.id = hit.id UNION ALL"
    " SELECT s.id, s.street_name, s.status FROM spots s LEFT JOIN cut ON cut.id = s.id LEFT JOIN hit ON hit.id = s.id"
    " WHERE hit.id IS NULL AND coalesce(d, 0) = 0"
)
oracle("apply_change_feed", "spots change_feed", _STATE, **change_state("change_feed"))
oracle(
    "filtered_change_feed", "spots change_feed", _STATE,
    **change_state("(SELECT * FROM change_feed WHERE op = 'DELETE' OR status = 'AVAILABLE') v"),
)
oracle(
    "update_messages", "archive_spots spot_operations",
    "SELECT CASE op WHEN 'create' THEN 'CREATE' WHEN 'update' THEN 'UPDATE' WHEN 'delete' THEN 'DELETE' ELSE 'AVAILABILITY_UPDATE' END"
    " AS update_type, o.id, CASE WHEN op <> 'delete' THEN s.address END AS address, CASE WHEN op <> 'delete' THEN s.available END AS available"
    " FROM spot_operations o LEFT JOIN archive_spots s ON s.id = o.id WHERE op = 'delete' OR s.id IS NOT NULL",
)
_CHECKED = {
    "sound": "SELECT *, CASE WHEN op IN ('create', 'update') THEN CASE WHEN latitude IS NULL THEN 'latitude_required'"
    " WHEN longitude IS NULL THEN 'longitude_required' WHEN trim(address) = '' THEN 'address_required'"
    " WHEN price <= 0 THEN 'price_not_positive' END END AS problem FROM spot_operations",
    "births": "SELECT id, min(CASE WHEN k THEN -1 ELSE seq END) AS born FROM (SELECT id, seq, false AS k FROM sound WHERE op = 'create'"
    " AND problem IS NULL UNION ALL SELECT id, -1, true FROM archive_spots) b GROUP BY id",
    "deaths": "SELECT s.id, min(seq) AS died FROM sound s JOIN births b ON b.id = s.id WHERE op = 'delete' AND seq > born GROUP BY s.id",
    "judged": "SELECT s.*, CASE WHEN problem IS NOT NULL THEN problem WHEN op = 'create' THEN CASE WHEN seq > born THEN 'id_taken' END"
    " WHEN born IS NULL OR seq < born OR seq > died THEN 'not_found' END AS reject_reason"
    " FROM sound s LEFT JOIN births b ON b.id = s.id LEFT JOIN deaths d ON d.id = s.id",
}
oracle(
    "spot_operation_rejects", "archive_spots spot_operations",
    "SELECT seq, op, id, reject_reason FROM judged WHERE reject_reason IS NOT NULL", **_CHECKED,
)
oracle(
    "spot_operations", "archive_spots spot_operations",
    "SELECT r.id, address, latitude, longitude, flag AS available, price, restrictions FROM rows_ r JOIN flags g ON g.id = r.id"
    " WHERE nth = 1 AND r.id NOT IN (SELECT id FROM deaths)",
    **_CHECKED,
    history="SELECT id, -1 AS seq, address, latitude, longitude, available, price, restrictions, 'update' AS op FROM archive_spots"
    " UNION ALL SELECT id, seq, address, latitude, longitude, available, price, restrictions, op FROM judged WHERE reject_reason IS NULL",
    rows_="SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS nth FROM history WHERE op IN ('create', 'update')",
    flags="SELECT id, arg_max(available, seq) AS flag FROM history WHERE op <> 'delete' GROUP BY id",
)
oracle(
    "upsert_snapshot", "spots changed_spots",
    """SELECT coalesce(s.id, c.id) AS id, coalesce(c.street_name, s.street_name) AS street_name, s.address,
  coalesce(c.status, s.status) AS status, coalesce(s.source, c.source) AS source,
  CASE WHEN c.id IS NULL THEN s.updated_at ELSE TIMESTAMP '2024-01-30 12:00:00' END AS updated_at,
  CASE WHEN s.id IS NULL THEN 'inserted' WHEN c.id IS NULL THEN 'unchanged' ELSE 'updated' END AS change
FROM spots s FULL JOIN changed_spots c ON c.id = s.id""",
)
oracle(
    "insert_absent_favorites", "favorite_log toggle_requests",
    "SELECT seq, user_id, parking_spot_id, op, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, parking_spot_id"
    " ORDER BY ts, seq) AS nth FROM favorite_log WHERE op = 'add') f WHERE nth = 1 AND NOT EXISTS"
    " (SELECT 1 FROM toggle_requests t WHERE t.user_id = f.user_id AND t.parking_spot_id = f.parking_spot_id)",
)

# --- integrity ------------------------------------------------------------

oracle(
    "domain_violations", "reports",
    "SELECT id, concat_ws('; ', CASE WHEN user_id IS NULL THEN 'user_id is null' END, CASE WHEN status = 'TAKEN' THEN"
    " 'status not allowed' END) AS violations FROM reports WHERE user_id IS NULL OR status = 'TAKEN'",
)
oracle("orphan_reports", "reports spots", "SELECT * FROM reports WHERE parking_spot_id NOT IN (SELECT id FROM spots)")
oracle(
    "cascade_delete", "reports spots",
    "SELECT * FROM reports WHERE parking_spot_id NOT IN (SELECT id FROM spots WHERE status = 'UNKNOWN')",
)
oracle(
    "set_null_on_delete", "analytics_events users",
    "SELECT id, CASE WHEN user_id IN (SELECT id FROM users WHERE raw_user_meta_data = '{}') THEN NULL ELSE user_id END AS user_id,"
    " event_name FROM analytics_events",
)


def repeated(name: str, source: str, keys: str) -> str:
    return (
        f"SELECT '{name}' AS table_name, '{keys}' AS key_columns, count(*) AS duplicate_keys, coalesce(max(n), 0) AS worst_count"
        f" FROM (SELECT count(*) AS n FROM {source} GROUP BY {keys} HAVING count(*) > 1) k"
    )


oracle(
    "unique_key_check", "spots favorite_log waitlist_raw meter_feed",
    " UNION ALL ".join(
        [
            repeated("parking_spots", "spots", "id"),
            repeated("favorite_log", "favorite_log", "user_id,parking_spot_id"),
            repeated("waitlist_signups", "signups", "email"),
            repeated("city_parking_meters", "usable", "source_id,external_id"),
        ]
    ),
    signups=_SIGNUPS, **FEED, usable="SELECT 's' AS source_id, external_id FROM mapped WHERE skip_reason IS NULL",
)

# --- curb rules -----------------------------------------------------------

_NEAR = haversine("anchor_latitude", "anchor_longitude", "s.latitude", "s.longitude")
_PAIRS = (
    "SELECT s.id AS spot_id, r.id AS rule_id FROM faced_spots s JOIN curb_rules r ON s.blockface_id = r.blockface_id WHERE is_active"
    " UNION SELECT s.id, r.id FROM faced_spots s JOIN curb_rules r ON abs(s.latitude - anchor_latitude) < 0.001"
    f" AND abs(s.longitude - anchor_longitude) < 0.001 WHERE is_active AND {_NEAR} <= 25 / 1609.344e0"
)
_DETAILED = "SELECT p.spot_id, r.* EXCLUDE (id), r.id AS rule_id FROM pairs p JOIN curb_rules r ON r.id = p.rule_id"
oracle("spot_rules", "faced_spots curb_rules", _PAIRS)
_STRICTEST = (
    "SELECT spot_id, rule_id, regulation_type, priority FROM (SELECT *, row_number() OVER (PARTITION BY spot_id"
    " ORDER BY priority DESC, rule_id DESC) AS nth FROM detailed) d WHERE nth = 1"
)
oracle("strictest_rules", "faced_spots curb_rules", _STRICTEST, pairs=_PAIRS, detailed=_DETAILED)


def sweeping(now: str) -> dict:
    """Every date of the next weeks that a window falls on."""
    return {
        "named": "SELECT *, CASE substr(weekday, 1, 3) WHEN 'Sun' THEN 0 WHEN 'Mon' THEN 1 WHEN 'Tue' THEN 2 WHEN 'Wed' THEN 3"
        " WHEN 'Thu' THEN 4 WHEN 'Fri' THEN 5 ELSE 6 END AS dow FROM sweeping_rules WHERE is_active",
        "days": f"SELECT CAST(CAST('{now}' AS DATE) + CAST(i AS INTEGER) AS DATE) AS day FROM range(-1, 120) t(i)",
        "held": "SELECT n.id, n.blockface_id, day + CAST(s AS TIME) AS starts,"
        # A window that ends at or before its start runs into the next day.
        " day + CAST(e AS TIME) + INTERVAL 1 DAY * CAST(e <= s AS INTEGER) AS ends"
        " FROM (SELECT *, lpad(start_time, 5, '0') AS s, lpad(end_time, 5, '0') AS e FROM named) n JOIN days ON dayofweek(day) = dow AND (weeks_of_month IS NULL OR"
        " contains(weeks_of_month, CAST(CAST(ceil(dayofmonth(day) / 7.0) AS INTEGER) AS VARCHAR)))",
        "windows": f"SELECT n.id, n.blockface_id, coalesce(bool_or(TIMESTAMP '{now}' >= starts AND TIMESTAMP '{now}' < ends), false)"
        f" AS in_force, min(CASE WHEN starts > TIMESTAMP '{now}' THEN starts END) AS next_start"
        " FROM named n LEFT JOIN held h ON h.id = n.id GROUP BY n.id, n.blockface_id",
        "faces": "SELECT blockface_id, bool_or(in_force) AS sweeping_now, min(next_start) AS next_sweeping FROM windows GROUP BY 1",
    }


oracle(
    "sweeping_windows", "sweeping_rules", "SELECT id, in_force, next_start FROM windows", **sweeping("2024-01-29 09:15:00")
)
oracle(
    "parking_allowed", "faced_spots curb_rules sweeping_rules",
    "SELECT s.id AS spot_id, NOT (coalesce(sweeping_now, false) OR s.id IN (SELECT spot_id FROM detailed WHERE regulation_type = 'NO_PARKING'"
    # Monday, 09:15: day windows and those of the night from Sunday.
    " AND CASE WHEN hours IS NULL OR hours = '800-1800' THEN days_of_week IS NULL OR days_of_week IN ('Mon-Fri', 'M-F')"
    " ELSE days_of_week IS NULL OR days_of_week IN ('Sat,Sun', 'Su') END))"
    " AS allowed FROM faced_spots s LEFT JOIN faces f ON f.blockface_id = s.blockface_id",
    pairs=_PAIRS, detailed=_DETAILED, **sweeping("2024-01-15 09:15:00"),
)
_ZONES = (
    "SELECT s.id AS spot_id, z.id AS zone_id FROM faced_spots s JOIN zones z ON is_active"
    " AND abs(s.longitude * 1e5 + 12200000 + 38500.5e0 + z.id * 500) / 1200 + abs(s.latitude * 1e5 - 3770000 - 1900.5e0 - z.id * 300) / 800 < 1"
)
oracle("zone_of_spot", "faced_spots zones", _ZONES)
oracle(
    "zone_by_code", "faced_spots zones",
    "SELECT s.id AS spot_id, z.id AS zone_id FROM faced_spots s JOIN zones z USING (zone_code) WHERE is_active",
)
oracle(
    "spot_context", "faced_spots curb_rules sweeping_rules zones",
    """SELECT s.id AS spot_id, coalesce(c.n, 0) AS rule_count, t.rule_id AS strictest_rule_id,
  t.regulation_type AS strictest_regulation, coalesce(sweeping_now, false) AS sweeping_now, next_sweeping, zone_ids,
  c.imported AS rules_imported_at
FROM faced_spots s LEFT JOIN (SELECT spot_id, count(*) AS n, max(imported_at) AS imported FROM detailed GROUP BY 1) c ON c.spot_id = s.id
LEFT JOIN strictest t ON t.spot_id = s.id LEFT JOIN faces f ON f.blockface_id = s.blockface_id
LEFT JOIN (SELECT spot_id, string_agg(CAST(zone_id AS VARCHAR), ',' ORDER BY zone_id) AS zone_ids FROM placed GROUP BY 1) z ON z.spot_id = s.id""",
    pairs=_PAIRS, detailed=_DETAILED, strictest=_STRICTEST, placed=_ZONES, **sweeping("2024-01-15 09:15:00"),
)

# --- streams --------------------------------------------------------------

_SEES = "coalesce({0}.latitude BETWEEN south AND north AND {0}.longitude BETWEEN west AND east AND (v.status IS NULL OR {0}.status = v.status), false)"
oracle(
    "viewer_messages", "moving_feed viewers",
    "SELECT viewer_id, CASE WHEN NOT sees THEN 'WITHDRAW' WHEN saw THEN 'UPDATE' ELSE 'ENTER' END AS message, id, ts, seq,"
    " CASE WHEN sees THEN after.latitude END AS latitude, CASE WHEN sees THEN after.longitude END AS longitude,"
    " CASE WHEN sees THEN after.status END AS status FROM told WHERE saw OR sees",
    played="SELECT *, coalesce(last_value(CASE WHEN op <> 'UPDATE' THEN op = 'INSERT' END IGNORE NULLS)"
    " OVER (PARTITION BY id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), false) AS there FROM moving_feed",
    shown="SELECT id, ts, seq, CASE WHEN there THEN {'latitude': latitude, 'longitude': longitude, 'status': status} END AS after FROM played",
    changed="SELECT *, lag(after) OVER (PARTITION BY id ORDER BY ts, seq) AS before FROM shown",
    told=f"SELECT viewer_id, id, ts, seq, after, {_SEES.format('before')} AS saw, {_SEES.format('after')} AS sees FROM changed, viewers v",
)
ORACLES["stream_viewer_messages"] = ORACLES["viewer_messages"]
ORACLES["stream_change_feed"] = ORACLES["apply_change_feed"]
ORACLES["stream_reports"] = ORACLES["apply_reports"]
ORACLES["stream_accepted_reports"] = ORACLES["accepted_reports"]
ORACLES["stream_rejected_reports"] = ORACLES["rejected_reports"]
oracle(
    "stream_events", "analytics_events",
    "SELECT event_id AS id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE user_id END AS user_id, event_type AS event_name,"
    " props->>'$.k' AS k, ts AS created_at, CAST(ts AS DATE) AS event_date FROM events",
)

_FACED = "FROM reports r JOIN faced_spots s ON s.id = r.parking_spot_id WHERE blockface_id IS NOT NULL"
oracle(
    "stream_reports_per_blockface", "reports faced_spots",
    "SELECT blockface_id, date_trunc('day', created_at) AS window_start, status, count(*) AS reports, CAST(0 AS BIGINT) AS late_reports,"
    " max(created_at) AS last_report_at, date_trunc('day', created_at) + INTERVAL 31 DAY <= (SELECT max(created_at) " + _FACED + ") AS closed "
    + _FACED + " GROUP BY ALL",
)
_KEYED = "SELECT {0} AS id, {1} FROM {2}"
oracle(
    "declared_key_check", "spots reports waitlist_raw meter_feed block_feed favorite_log analytics_events users",
    " UNION ALL ".join(
        [
            repeated("parking_spots", "spots", "id"),
            repeated("parking_reports", "reports", "id"),
            repeated("waitlist_signups", "signups_", "id"),
            repeated("waitlist_signups", "signups_", "email"),
            repeated("city_parking_sources", "(SELECT unnest(['a', 'b', 'c']) AS id)", "id"),
            repeated("city_parking_sources", "(SELECT unnest(['a', 'b', 'c']) AS source_key)", "source_key"),
            repeated("city_parking_blocks", "blocks_", "id"),
            repeated("city_parking_blocks", "blocks_", "source_id,external_id"),
            repeated("city_parking_meters", "meters_", "id"),
            repeated("city_parking_meters", "meters_", "source_id,external_id"),
            repeated("normalized_parking_locations", "locations_", "id"),
            repeated("normalized_parking_locations", "locations_", "source_type,source_id"),
            repeated("favorite_parking_spots", "favorites_", "id"),
            repeated("favorite_parking_spots", "favorites_", "user_id,parking_spot_id"),
            repeated("analytics_events", "analytics_events", "id"),
            repeated("profiles", "users", "id"),
        ]
    ),
    **METERS, blocks=_BLOCKS, locations=_LOCATIONS, signups=_SIGNUPS,
    signups_=_KEYED.format("seq", "email", "signups"), favorites_=_KEYED.format("seq", "user_id, parking_spot_id", "favorite_log"),
    blocks_=_KEYED.format("external_id", "'b' AS source_id, external_id", "blocks"),
    meters_=_KEYED.format("external_id", "'m' AS source_id, external_id", "meters"),
    locations_=_KEYED.format("source_id", "source_type, source_id", "locations"),
)

ORACLES["strictest_rules_folded"] = ORACLES["strictest_rules"]
