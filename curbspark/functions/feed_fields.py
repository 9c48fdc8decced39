"""Field names under which city feeds deliver their values.

Feeds rename fields without notice, so each value has a list of names; the
first one with content counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted field names, in order of preference.
LATITUDE = ("latitude", "lat", "y")
LONGITUDE = ("longitude", "lng", "long", "x")
PLAIN_LATITUDE = ("latitude", "lat")
PLAIN_LONGITUDE = ("longitude", "lng", "long")
STREET = ("street_name", "streetname", "street")
STREET_NUMBER = ("street_num", "streetnum", "street_number")
NEIGHBORHOOD = ("analysis_neighborhood", "neighborhood")
PLACE = ("location", "address", "location_description")

METER_ID = ("post_id", "postid", "meter_id", "meterid")
METER_OBJECT_ID = ("objectid", "object_id", "id")
METER_POST_ID = ("post_id", "postid")
METER_BLOCKFACE = ("blockface_id", "blockface")
METER_STREET = ("street_name", "streetname")
METER_TYPE = ("meter_type", "metertype")
CAP_COLOR = ("cap_color", "capcolor")
ON_OFFSTREET = ("on_offstreet_type", "on_off_str", "onoffstreet")
ACTIVE_FLAG = ("active_meter_flag", "active_meter", "active", "status")
JURISDICTION = ("jurisdiction",)

BLOCK_ID = ("objectid", "object_id", "id", "globalid")
BLOCK_ROW_ID = (":id",)
BLOCK_BLOCKFACE = ("blockface_id", "blockface", "blockfaceid", "blkface_id")
BLOCK_STREET = ("street_name", "streetname", "street", "name")
CROSS_FROM = ("from_street", "fromstreet", "cross_street_1")
CROSS_TO = ("to_street", "tostreet", "cross_street_2")
SPACES = ("number_of_spaces", "spaces", "space_count", "num_spaces")

RULE_BLOCKFACE = ("blockface_id", "blockface", "blkface_id", "blockfaceid")
RULE_NAME = ("name",)
RULE_TYPE = ("regulation", "regulation_type", "type")
AGENCY = ("agency",)
DAYS = ("days", "days_of_week")
HOURS = ("hours",)
HOUR_LIMIT = ("hrlimit", "hr_limit", "hour_limit")
PERMIT_AREA = ("permitarea", "permit_area")

METER_FIELDS = (
    LATITUDE + LONGITUDE + STREET + STREET_NUMBER + NEIGHBORHOOD + PLACE + METER_ID + METER_OBJECT_ID
    + METER_BLOCKFACE + METER_TYPE + CAP_COLOR + ON_OFFSTREET + ACTIVE_FLAG + JURISDICTION
)
BLOCK_FIELDS = (
    LATITUDE + LONGITUDE + ("location",) + BLOCK_ID + BLOCK_ROW_ID + BLOCK_BLOCKFACE + BLOCK_STREET
    + CROSS_FROM + CROSS_TO + SPACES
)
RULE_FIELDS = (
    RULE_BLOCKFACE + RULE_NAME + RULE_TYPE + AGENCY + DAYS + HOURS + HOUR_LIMIT + PERMIT_AREA
)

_NESTED_POINT = "latitude double, longitude double"


def parse_record(raw: Column, fields: tuple[str, ...]) -> Column:
    """Struct with the listed fields as text, from one pass over the JSON.

    `shape.coordinates` comes typed, since only real JSON numbers count there.
    A record that is no JSON object has null in every field.
    """
    schema = T.StructType([T.StructField(name, T.StringType()) for name in dict.fromkeys(fields)])
    schema.add("shape", T.StructType().add("coordinates", T.ArrayType(T.DoubleType())))
    return F.from_json(raw, schema)


def nested_location(record: Column) -> Column:
    """`location` as a point; quoted numbers inside it are not numbers."""
    return F.from_json(record["location"], _NESTED_POINT)
