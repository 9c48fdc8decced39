"""Labels, colours, relative times and prices as shown to people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display texts.
STATUS_LABELS = {"AVAILABLE": "Available", "OCCUPIED": "Occupied", "UNKNOWN": "Unknown"}
TYPE_LABELS = {
    "METERED": "Metered",
    "FREE": "Free",
    "LOADING_ZONE": "Loading Zone",
    "STREET_SWEEPING": "Street Sweeping",
    "GARAGE": "Garage",
    "UNKNOWN": "Unknown",
}
MARKER_COLORS = {"AVAILABLE": "#22c55e", "OCCUPIED": "#ef4444", "UNKNOWN": "#a3a3a3"}
PIN_COLORS = {"AVAILABLE": "green", "OCCUPIED": "red"}
OTHER_PIN_COLOR = "gray"


def _lookup(value: Column, table: dict[str, str], other: str) -> Column:
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.coalesce(F.create_map(*pairs)[value], F.lit(other))


def status_label(status: Column) -> Column:
    return _lookup(status, STATUS_LABELS, "Unknown")


def type_label(parking_type: Column) -> Column:
    return _lookup(parking_type, TYPE_LABELS, "Unknown")


def marker_color(status: Column) -> Column:
    return _lookup(status, MARKER_COLORS, MARKER_COLORS["UNKNOWN"])


def pin_color(status: Column) -> Column:
    return _lookup(status, PIN_COLORS, OTHER_PIN_COLOR)


def _elapsed_minutes(ts: Column, now: Column) -> Column:
    elapsed_ms = F.unix_millis(now.cast("timestamp")) - F.unix_millis(ts.cast("timestamp"))
    return F.floor(elapsed_ms / 60_000)


def updated_label(ts: Column, now: Column) -> Column:
    """`Never`, `Just now`, `5 min ago`, `3 hr ago` or `Jan 2, 2024`."""
    minutes = _elapsed_minutes(ts, now)
    hours = F.floor(minutes / 60)
    return (
        F.when(ts.isNull(), "Never")
        .when(minutes < 1, "Just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit(" hr ago")))
        .otherwise(F.date_format(ts, "MMM d, yyyy"))
    )


def time_ago(ts: Column, now: Column) -> Column:
    """`Just now`, `5m ago`, `3h ago` or `2d ago`."""
    minutes = _elapsed_minutes(ts, now)
    hours = F.floor(minutes / 60)
    days = F.floor(hours / 24)
    return (
        F.when(minutes < 1, "Just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .otherwise(F.concat(days.cast("string"), F.lit("d ago")))
    )


def display_price(price: Column) -> Column:
    return F.when(price.startswith("$"), price).otherwise(F.concat(F.lit("$"), price))
