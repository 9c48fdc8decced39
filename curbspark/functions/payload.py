"""Cleaning of free-form event payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: entries kept per payload.
MAX_PAYLOAD_KEYS = 10


def _is_primitive(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return ~(kind.startswith("OBJECT") | kind.startswith("ARRAY"))


def sanitize_payload(payload: Column) -> Column:
    """JSON object with at most ten entries, nested values dropped.

    Dropped values do not count toward the ten.  Keys keep their order; of a
    repeated key the last value counts, at the place of its first appearance.
    Text that is no JSON object gives an empty object.
    """
    values = F.from_json(payload, "map<string,variant>")
    entries, keys = F.map_entries(values), F.map_keys(values)
    # Repeated keys are rare and looking for them is quadratic, so only then.
    repeats = F.size(F.array_distinct(keys)) < F.size(keys)
    return F.coalesce(
        F.when(repeats, _kept_as_json(_last_entries(entries, keys))).otherwise(_kept_as_json(entries)),
        F.lit("{}"),
    )


def _last_entries(entries: Column, keys: Column) -> Column:
    return F.transform(
        F.array_distinct(keys),
        lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1),
    )


def _kept_as_json(entries: Column) -> Column:
    kept = F.filter(entries, lambda e: e["value"].isNull() | _is_primitive(e["value"]))
    return F.to_json(F.map_from_entries(F.slice(kept, 1, MAX_PAYLOAD_KEYS)))
