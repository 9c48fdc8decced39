"""Table schemas, keys and value domains of the parking data model."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Domains that stored rows must satisfy.
STATUSES = ("AVAILABLE", "OCCUPIED", "UNKNOWN")
PARKING_TYPES = ("METERED", "FREE", "LOADING_ZONE", "STREET_SWEEPING", "GARAGE", "UNKNOWN")
SPOT_SOURCES = ("MOCK", "DATASF", "SFMTA", "USER_REPORT")
PROVIDERS = ("DATASF", "SFMTA")
EVENT_NAMES = (
    "parking_list_viewed",
    "parking_spot_opened",
    "directions_clicked",
    "report_submitted",
    "favorite_added",
    "favorite_removed",
)


def _struct(required: str, optional: str = "") -> T.StructType:
    """Schema from two `name type` lists; the first holds the NOT NULL columns."""
    out = T.StructType()
    for text, nullable in ((required, False), (optional, True)):
        for item in filter(None, (part.strip() for part in text.split(","))):
            name, kind = item.split()
            out.add(name, kind, nullable)
    return out


PROFILES = _struct("id string", "full_name string, email string, created_at timestamp, updated_at timestamp")
SPOTS = _struct(
    "id string, street_name string, latitude double, longitude double, status string, parking_type string, source string",
    "address string, price string, time_limit string, updated_at timestamp, created_at timestamp",
)
REPORTS = _struct(
    "id string, user_id string, parking_spot_id string, status string", "note string, created_at timestamp"
)
WAITLIST = _struct("id string, email string", "full_name string, interest string, created_at timestamp")
SOURCES = _struct(
    "id string, source_key string, display_name string, provider string, dataset_id string, api_base_url string",
    "description string, last_imported_at timestamp, last_row_count long, created_at timestamp, updated_at timestamp",
)
BLOCKS = _struct(
    "id string, source_id string, external_id string",
    "blockface_id string, street_name string, cross_street_from string, cross_street_to string, spaces_count integer,"
    "latitude double, longitude double, regulation_type string, agency string, days_of_week string, hours string,"
    "hour_limit integer, permit_area string, raw_payload string, imported_at timestamp, updated_at timestamp",
)
METERS = _struct(
    "id string, source_id string, external_id string, latitude double, longitude double",
    "post_id string, blockface_id string, block_id string, street_name string, street_num string, meter_type string,"
    "cap_color string, on_offstreet_type string, active_meter_flag string, jurisdiction string, raw_payload string,"
    "imported_at timestamp, updated_at timestamp",
)
LOCATIONS = _struct(
    "id string, source_type string, source_id string, latitude double, longitude double, parking_type string,"
    "active boolean, city string",
    "address string, time_limit string, restrictions string, raw_source string, last_synced_at timestamp,"
    "created_at timestamp, updated_at timestamp",
)
FAVORITES = _struct("id string, user_id string, parking_spot_id string", "created_at timestamp")
EVENTS = _struct("id string, event_name string", "user_id string, event_payload string, created_at timestamp")


@dataclass(frozen=True)
class TableRules:
    """What a stored row must satisfy: NOT NULL columns, value lists, unique keys."""

    required: tuple[str, ...] = ()
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)
    unique: tuple[tuple[str, ...], ...] = ()


def _required(schema: T.StructType) -> tuple[str, ...]:
    return tuple(f.name for f in schema.fields if not f.nullable)


RULES = {
    "parking_spots": TableRules(
        _required(SPOTS),
        {"status": STATUSES, "parking_type": PARKING_TYPES, "source": SPOT_SOURCES},
        (("id",),),
    ),
    "parking_reports": TableRules(_required(REPORTS), {"status": STATUSES}, (("id",),)),
    "waitlist_signups": TableRules(_required(WAITLIST), {}, (("id",), ("email",))),
    "city_parking_sources": TableRules(
        _required(SOURCES), {"provider": PROVIDERS}, (("id",), ("source_key",))
    ),
    "city_parking_blocks": TableRules(_required(BLOCKS), {}, (("id",), ("source_id", "external_id"))),
    "city_parking_meters": TableRules(_required(METERS), {}, (("id",), ("source_id", "external_id"))),
    "normalized_parking_locations": TableRules(
        _required(LOCATIONS), {"parking_type": PARKING_TYPES}, (("id",), ("source_type", "source_id"))
    ),
    "favorite_parking_spots": TableRules(
        _required(FAVORITES), {}, (("id",), ("user_id", "parking_spot_id"))
    ),
    "analytics_events": TableRules(_required(EVENTS), {}, (("id",),)),
    "profiles": TableRules(_required(PROFILES), {}, (("id",),)),
}
