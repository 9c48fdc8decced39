"""Coordinate checks, great-circle distance and search boxes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Distances must agree with stored results.
EARTH_KM = 6371
KM_PER_MILE = 1.609344
METERS_PER_MILE = 1609.344
METERS_PER_DEGREE = 111_000


def valid_coordinate(lat: Column, lng: Column) -> Column:
    """Finite and on the globe, bounds included; null and NaN are invalid."""
    return F.coalesce(lat.between(-90, 90) & lng.between(-180, 180), F.lit(False))


def is_point(lat: float, lng: float) -> bool:
    """`valid_coordinate` for plain arguments."""
    return -90 <= lat <= 90 and -180 <= lng <= 180


def radians(degrees: Column) -> Column:
    return degrees * math.pi / 180


def haversine_miles(
    lat1: Column, lng1: Column, lat2: Column, lng2: Column, cosines: tuple[Column, Column] | None = None
) -> Column:
    """Great-circle distance in miles; the cosines of both latitudes may be given where pairs share them."""
    cos1, cos2 = cosines or (F.cos(radians(lat1)), F.cos(radians(lat2)))
    half_dlat = F.sin(radians(lat2 - lat1) / 2)
    half_dlng = F.sin(radians(lng2 - lng1) / 2)
    a = half_dlat * half_dlat + cos1 * cos2 * half_dlng * half_dlng
    return EARTH_KM * (2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))) / KM_PER_MILE


def rounded_miles(miles: Column, digits: int = 6) -> Column:
    """`F.round`, which goes through decimal text, only near ties and for what is no usual distance."""
    scale = 10.0**digits
    scaled = miles * scale
    plain = miles.between(0, 1e12 / scale) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3)
    return F.when(plain, F.floor(scaled + 0.5) / scale).otherwise(F.round(miles, digits))


def degrees_offset(meters: float) -> float:
    """Half side of a search box, the same for latitude and longitude."""
    return meters / METERS_PER_DEGREE


def in_box(lat: Column, lng: Column, center_lat: float, center_lng: float, offset: float) -> Column:
    """Inclusive box; plain comparisons, so Parquet can skip row groups."""
    return lat.between(center_lat - offset, center_lat + offset) & lng.between(
        center_lng - offset, center_lng + offset
    )


def cap_half_width(lat_degrees: float, radius_km: float) -> float:
    """Degrees of longitude a circle spans to each side at its widest parallel."""
    angle = radius_km / EARTH_KM
    if abs(lat_degrees) + math.degrees(angle) >= 90:
        return 180.0
    return math.degrees(math.asin(math.sin(angle) / math.cos(math.radians(lat_degrees))))


def covering_box(lat: Column, lng: Column, center_lat: float, center_lng: float, radius_miles: float) -> Column:
    """Box that holds the whole circle, across the date line and the poles too."""
    km = radius_miles * KM_PER_MILE
    margin = 1e-9
    half_lat = math.degrees(km / EARTH_KM) + margin
    half_lng = cap_half_width(center_lat, km) + margin
    box = lat.between(center_lat - half_lat, center_lat + half_lat)
    if half_lng >= 180:
        return box
    west, east = center_lng - half_lng, center_lng + half_lng
    sides = lng.between(west, east)
    if west < -180:
        sides = sides | (lng >= west + 360)
    if east > 180:
        sides = sides | (lng <= east - 360)
    return box & sides
