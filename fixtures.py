"""Parking-shaped inputs derived from the given tables.

Each view is one SQL text that Spark and DuckDB both run; `{customer}` and the
like stand for the base tables.  Key columns carry the names the library uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "events")

_LAT = "37.70e0 + ({k} * 7919 % 10000) / 1e5"
_LNG = "-122.52e0 + ({k} * 104729 % 15000) / 1e5"


def _point(key: str) -> tuple[str, str]:
    return _LAT.replace("{k}", key), _LNG.replace("{k}", key)


_CLAT, _CLNG = _point("c_custkey")
_SLAT, _SLNG = _point("s_suppkey")
_PLAT, _PLNG = _point("p_partkey")

VIEWS: dict[str, str] = {}

VIEWS["spots"] = f"""
SELECT c_custkey AS id, c_mktsegment || ' St' AS street_name,
  CASE WHEN c_custkey % 11 = 0 THEN NULL
    ELSE CAST(c_custkey % 900 + 100 AS VARCHAR(10)) || ' ' || c_mktsegment || ' St, San Francisco, CA' END AS address,
  {_CLAT} AS latitude, {_CLNG} AS longitude,
  CASE c_custkey % 3 WHEN 0 THEN 'AVAILABLE' WHEN 1 THEN 'OCCUPIED' ELSE 'UNKNOWN' END AS status,
  CASE c_custkey % 6 WHEN 0 THEN 'METERED' WHEN 1 THEN 'FREE' WHEN 2 THEN 'LOADING_ZONE'
    WHEN 3 THEN 'STREET_SWEEPING' WHEN 4 THEN 'GARAGE' ELSE 'UNKNOWN' END AS parking_type,
  CASE WHEN c_custkey % 6 = 0 THEN '$3.50/hr' WHEN c_custkey % 6 = 4 THEN '5.00/hr' END AS price,
  CASE WHEN c_custkey % 6 = 0 THEN '2 hours' END AS time_limit,
  CASE WHEN c_custkey % 2 = 0 THEN 'MOCK' ELSE 'DATASF' END AS source,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * CAST(c_custkey * 37 % 40000 AS INT) AS updated_at
FROM {{customer}}"""

VIEWS["reports"] = """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderkey % 150 END AS user_id,
  CASE WHEN o_orderkey % 89 = 0 THEN -1 ELSE o_custkey END AS parking_spot_id,
  CASE WHEN o_orderkey % 83 = 0 THEN 'TAKEN' WHEN o_orderstatus = 'F' THEN 'AVAILABLE'
    WHEN o_orderstatus = 'O' THEN 'OCCUPIED' ELSE 'UNKNOWN' END AS status,
  o_orderdate AS created_at
FROM {orders}"""

VIEWS["status_probes"] = """
SELECT o_orderkey AS probe_id, CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS parking_spot_id,
  o_orderdate + INTERVAL '1' DAY * CAST(o_orderkey % 90 - 10 AS INT) AS asked_at
FROM {orders}"""

VIEWS["favorite_log"] = """
SELECT event_id AS seq, user_id, event_id % 50 AS parking_spot_id,
  CASE WHEN event_type = 'error' THEN 'remove' ELSE 'add' END AS op, ts
FROM {events} WHERE event_type IN ('click', 'purchase', 'error')"""

VIEWS["toggle_requests"] = """
SELECT event_id AS seq, user_id, event_id % 50 AS parking_spot_id, ts FROM {events} WHERE event_type = 'view'"""

VIEWS["change_feed"] = """
SELECT event_id AS seq, ts, user_id AS id,
  CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS op,
  CASE event_id % 3 WHEN 0 THEN 'AVAILABLE' WHEN 1 THEN 'OCCUPIED' ELSE 'UNKNOWN' END AS status
FROM {events}"""

# Spots that wander between nine places; every seventh event has none.
VIEWS["moving_feed"] = """
SELECT event_id AS seq, ts, user_id AS id,
  CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS op,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE 37.70e0 + event_id % 3 / 20e0 END AS latitude,
  -122.50e0 + event_id % 9 / 40e0 AS longitude,
  CASE event_id % 4 WHEN 0 THEN 'AVAILABLE' WHEN 1 THEN 'OCCUPIED' WHEN 2 THEN 'UNKNOWN' END AS status
FROM {events}"""

VIEWS["viewers"] = """
SELECT n_nationkey AS viewer_id, 37.68e0 + n_nationkey % 5 / 50e0 AS south, -122.52e0 + n_nationkey % 7 / 50e0 AS west,
  37.70e0 + n_nationkey % 4 / 20e0 AS north, CASE WHEN n_nationkey % 11 = 0 THEN 180e0 ELSE -122.41e0 + n_nationkey % 3 / 20e0 END AS east,
  CASE n_nationkey % 3 WHEN 0 THEN 'AVAILABLE' WHEN 1 THEN 'OCCUPIED' END AS status
FROM {nation}"""

VIEWS["meter_feed"] = """
SELECT p_partkey AS feed_pos, CASE p_partkey % 10
  WHEN 0 THEN '{{"objectid":' || CAST(p_partkey AS VARCHAR(12)) || ',"street_name":"' || p_brand || '"}}'
  WHEN 1 THEN '{{"post_id":"P' || CAST(p_partkey AS VARCHAR(12)) || '","latitude":"137.7","longitude":"-122.4"}}'
  WHEN 2 THEN '{{"latitude":"37.7","longitude":"-122.4","streetname":"' || p_brand || '"}}'
  WHEN 3 THEN '{{"postid":" P' || CAST(p_partkey AS VARCHAR(12)) || ' ","shape":{{"type":"Point","coordinates":[-122.4'
    || CAST(p_partkey % 1000 + 1000 AS VARCHAR(6)) || ',37.7' || CAST(p_partkey % 1000 + 1000 AS VARCHAR(6))
    || ']}},"blockface_id":"BF' || CAST(p_partkey % 40 AS VARCHAR(6)) || '","active_meter_flag":"N"}}'
  WHEN 4 THEN '{{"post_id":"  ","objectid":' || CAST(p_partkey AS VARCHAR(12)) || ',"location":{{"latitude":37.7'
    || CAST(p_partkey % 1000 + 1000 AS VARCHAR(6)) || ',"longitude":-122.4' || CAST(p_partkey % 1000 + 1000 AS VARCHAR(6))
    || '}},"street":"' || p_brand || '","street_number":"12"}}'
  ELSE '{{"post_id":"P' || CAST(p_partkey - p_partkey % 2 AS VARCHAR(12)) || '","lat":"37.7'
    || CAST(p_partkey % 1000 + 1000 AS VARCHAR(6)) || '","lng":"-122.4' || CAST(p_partkey % 1000 + 1000 AS VARCHAR(6))
    || '","blockface":"BF' || CAST(p_partkey % 40 AS VARCHAR(6)) || '","street_name":"' || p_brand
    || '","street_num":"' || CAST(p_size AS VARCHAR(6)) || '","cap_color":"GREY","active":"Y"}}' END AS raw
FROM {part}"""

# The feed at a later time: a flag has become a boolean, a field has another name, another one is often left out.
VIEWS["later_meter_feed"] = f"""
SELECT feed_pos, replace(replace(CASE WHEN feed_pos % 4 <> 1 THEN replace(raw, '"cap_color":"GREY",', '') ELSE raw END,
  '"active":"Y"', '"active":true'), '"blockface_id"', '"block_face"') AS raw
FROM ({VIEWS["meter_feed"]}) f"""

VIEWS["block_feed"] = """
SELECT n_nationkey AS feed_pos, '{{"objectid":' || CAST(n_nationkey AS VARCHAR(6)) || ',"blockface_id":"BF'
  || CAST(n_nationkey AS VARCHAR(6)) || '","street":"' || n_name || '","num_spaces":"'
  || CAST(n_nationkey + 3 AS VARCHAR(6)) || '"}}' AS raw
FROM {nation}"""

VIEWS["regulation_feed"] = """
SELECT s_suppkey AS feed_pos, '{{"blockface":"BF' || CAST(s_nationkey + s_suppkey % 3 * 10 AS VARCHAR(6))
  || '","regulation":"Time limited","agency":"MTA","days":"M-F","hrlimit":"'
  || CAST(s_suppkey % 4 + 1 AS VARCHAR(6)) || '"}}' AS raw
FROM {supplier}"""

VIEWS["waitlist_raw"] = """
SELECT c_custkey AS seq, '  ' || c_name || ' ' AS full_name,
  CASE WHEN c_custkey % 13 = 0 THEN 'not-an-email'
    WHEN c_custkey % 2 = 0 THEN ' USER' || CAST(c_custkey % 500 AS VARCHAR(6)) || '@Example.com '
    ELSE 'user' || CAST(c_custkey % 500 AS VARCHAR(6)) || '@example.com' END AS email,
  CASE WHEN c_custkey % 5 = 0 THEN '   ' ELSE c_mktsegment END AS interest
FROM {customer}"""

VIEWS["analytics_events"] = """
SELECT event_id AS id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE user_id END AS user_id,
  CASE event_type WHEN 'view' THEN 'parking_list_viewed' WHEN 'click' THEN 'parking_spot_opened'
    WHEN 'purchase' THEN 'report_submitted' WHEN 'signup' THEN 'favorite_added' ELSE 'favorite_removed' END AS event_name,
  props AS event_payload, ts AS created_at
FROM {events}"""

# Inputs for operators the views above do not reach.

VIEWS["wide_payloads"] = """
SELECT event_id AS id, '{{"z":' || CAST(event_id AS VARCHAR(12)) || ',"nested":{{"a":1}},"list":[1,2],"name":"' || event_type
  || '","gone":null,"ok":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END
  || ',"k1":1,"k2":2,"k3":3,"k4":4,"k5":5,"k6":6,"k7":7,"k8":8}}' AS event_payload
FROM {events}"""

VIEWS["points"] = f"""
SELECT s_suppkey AS point_id, {_SLAT} + 0.0003e0 AS point_latitude, {_SLNG} AS point_longitude FROM {{supplier}}"""

# Points near the spots, on the far side of the globe, at its poles, and without valid coordinates.
VIEWS["world_points"] = f"""
SELECT c_custkey AS point_id,
  CASE c_custkey % 5 WHEN 0 THEN {_CLAT} + 0.0002e0 WHEN 1 THEN (c_custkey * 7919 % 18001) / 100e0 - 90e0
    WHEN 2 THEN 38e0 + (c_custkey % 100) / 50e0 WHEN 3 THEN {_CLAT} ELSE CASE WHEN c_custkey % 3 = 0 THEN 137.7e0 ELSE 90e0 END END AS point_latitude,
  CASE c_custkey % 5 WHEN 0 THEN {_CLNG} - 0.0003e0 WHEN 1 THEN (c_custkey * 104729 % 36001) / 100e0 - 180e0
    WHEN 2 THEN -121e0 - (c_custkey % 90) / 30e0 WHEN 3 THEN {_CLNG} WHEN 4 THEN 180e0 END AS point_longitude
FROM {{customer}}"""

VIEWS["archive_spots"] = f"""
SELECT c_custkey AS id, CAST(c_custkey % 900 + 100 AS VARCHAR(10)) || ' ' || c_mktsegment || ' St' AS address,
  {_CLAT} AS latitude, {_CLNG} AS longitude, c_custkey % 3 = 0 AS available,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE (c_custkey % 9 + 1) / 2e0 END AS price,
  CASE WHEN c_custkey % 7 = 0 THEN '2 hours' END AS restrictions
FROM {{customer}}"""

VIEWS["spot_operations"] = """
SELECT event_id AS seq,
  CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'update' WHEN 'error' THEN 'delete'
    ELSE 'availability' END AS op,
  CASE WHEN event_type = 'signup' OR event_id % 3 = 0 THEN 1000000 + event_id * 7 % 901 ELSE user_id END AS id,
  CASE WHEN event_id % 23 = 0 THEN '  ' ELSE CAST(event_id AS VARCHAR(12)) || ' Op St' END AS address,
  CASE WHEN event_id % 29 = 0 THEN NULL ELSE 37.70e0 + (event_id % 1000) / 1e4 END AS latitude,
  CASE WHEN event_id % 37 = 0 THEN NULL ELSE -122.50e0 + (event_id % 1000) / 1e4 END AS longitude,
  event_id % 2 = 0 AS available,
  CASE WHEN event_id % 31 = 0 THEN 0e0 WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 10 + 1) / 2e0 END AS price,
  CASE WHEN event_id % 4 = 0 THEN 'permit' END AS restrictions
FROM {events}"""

VIEWS["users"] = """
SELECT c_custkey AS id, 'user' || CAST(c_custkey AS VARCHAR(12)) || '@example.com' AS email,
  CASE WHEN c_custkey % 9 = 0 THEN '{{}}' ELSE '{{"full_name":"' || c_name || '"}}' END AS raw_user_meta_data,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * CAST(c_custkey % 5000 AS INT) AS created_at
FROM {customer}"""

VIEWS["profile_updates"] = """
SELECT event_id AS seq, user_id AS id, CASE WHEN event_id % 10 = 0 THEN user_id + 1 ELSE user_id END AS caller_id,
  CASE event_id % 12 WHEN 0 THEN ' ' WHEN 1 THEN 'X' ELSE 'Name ' || CAST(event_id AS VARCHAR(12)) END AS full_name
FROM {events} WHERE event_type IN ('signup', 'click')"""

VIEWS["changed_spots"] = """
SELECT c_custkey + 300 AS id, 'Changed St' AS street_name, 37.75e0 AS latitude, -122.45e0 AS longitude,
  CASE c_custkey % 2 WHEN 0 THEN 'OCCUPIED' ELSE 'AVAILABLE' END AS status, 'METERED' AS parking_type, 'SFMTA' AS source
FROM {customer}"""

VIEWS["faced_spots"] = f"""
SELECT c_custkey AS id, {_CLAT} AS latitude, {_CLNG} AS longitude,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'BF' || CAST(c_custkey - c_custkey % 10 AS VARCHAR(12)) END AS blockface_id,
  'Z' || CAST(c_nationkey AS VARCHAR(6)) AS zone_code
FROM {{customer}}"""

VIEWS["curb_rules"] = f"""
SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN NULL
    ELSE 'BF' || CAST(p_partkey - p_partkey % 10 AS VARCHAR(12)) END AS blockface_id,
  CASE p_partkey % 4 WHEN 0 THEN 'RPP' WHEN 1 THEN 'TIME_LIMITED' WHEN 2 THEN 'NO_PARKING' ELSE 'LOADING' END AS regulation_type,
  p_size % 5 AS priority, {_PLAT} + 0.0001e0 AS anchor_latitude, {_PLNG} AS anchor_longitude,
  p_partkey % 13 <> 0 AS is_active,
  CASE p_partkey % 5 WHEN 0 THEN 'Mon-Fri' WHEN 1 THEN 'Sat,Sun' WHEN 2 THEN 'M-F' WHEN 3 THEN 'Su' END AS days_of_week,
  CASE p_partkey % 3 WHEN 0 THEN '800-1800' WHEN 1 THEN '22:00 - 9:30' END AS hours,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * CAST(p_partkey % 999 AS INT) AS imported_at
FROM {{part}}"""

# Windows of the day and, each fifth, of the night; times with and without a leading zero.
VIEWS["sweeping_rules"] = """
SELECT s_suppkey AS id, 'BF' || CAST((s_suppkey - s_suppkey % 2) * 10 AS VARCHAR(12)) AS blockface_id,
  CASE s_suppkey % 7 WHEN 0 THEN 'Monday' WHEN 1 THEN 'Tue' WHEN 2 THEN 'Wednesday' WHEN 3 THEN 'Thu'
    WHEN 4 THEN 'Friday' WHEN 5 THEN 'Sat' ELSE 'Sunday' END AS weekday,
  CASE WHEN s_suppkey % 5 = 0 THEN '22:30' WHEN s_suppkey % 5 = 1 THEN '9:00' WHEN s_suppkey % 2 = 0 THEN '08:00' ELSE '12:30' END AS start_time,
  CASE WHEN s_suppkey % 5 = 0 THEN '9:30' WHEN s_suppkey % 2 = 0 THEN '10:00' ELSE '14:00' END AS end_time,
  CASE s_suppkey % 4 WHEN 0 THEN '1,3' WHEN 1 THEN '2,4' WHEN 2 THEN '5' END AS weeks_of_month,
  s_suppkey % 11 <> 0 AS is_active
FROM {supplier}"""

# Diamonds whose edges pass between the five-decimal coordinates of the spots.
VIEWS["zones"] = """
SELECT n_nationkey AS id, 'Z' || CAST(n_nationkey AS VARCHAR(6)) AS zone_code, n_nationkey % 8 <> 0 AS is_active,
  '{{"type":"Polygon","coordinates":[[[-122.' || CAST(39700 + n_nationkey * 500 AS VARCHAR(6)) || '5,37.7'
  || CAST(1900 + n_nationkey * 300 AS VARCHAR(6)) || '5],[-122.' || CAST(38500 + n_nationkey * 500 AS VARCHAR(6)) || '5,37.7'
  || CAST(2700 + n_nationkey * 300 AS VARCHAR(6)) || '5],[-122.' || CAST(37300 + n_nationkey * 500 AS VARCHAR(6)) || '5,37.7'
  || CAST(1900 + n_nationkey * 300 AS VARCHAR(6)) || '5],[-122.' || CAST(38500 + n_nationkey * 500 AS VARCHAR(6)) || '5,37.7'
  || CAST(1100 + n_nationkey * 300 AS VARCHAR(6)) || '5],[-122.' || CAST(39700 + n_nationkey * 500 AS VARCHAR(6)) || '5,37.7'
  || CAST(1900 + n_nationkey * 300 AS VARCHAR(6)) || '5]]]}}' AS boundary_geojson
FROM {nation}"""


def duckdb_view(name: str) -> str:
    """View text over the table names the oracle has registered."""
    return VIEWS[name].format(**{t: t for t in TABLES})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_zone(df: DataFrame) -> DataFrame:
    """Timestamp literals are zoned in Spark and plain in DuckDB; keep the wall clock."""
    zoned = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    paths = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    return without_zone(spark.sql(VIEWS[name].format(**paths)))
