"""Geometry on latitude and longitude columns, in degrees and metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_M = 6371000.0
METRES_PER_MILE = 1609.344
FEET_PER_METRE_SHOWN = 3.28084
METRES_PER_FOOT = 0.3048


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = F.sin(F.radians(lat2 - lat1) / 2)
    side = F.sin(F.radians(lon2 - lon1) / 2)
    a = half * half + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * side * side
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in [0, 360)."""
    d = F.radians(lon2 - lon1)
    a, b = F.radians(lat1), F.radians(lat2)
    angle = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.pmod(angle + 360, F.lit(360.0))


def angle_diff(a: Column, b: Column) -> Column:
    d = F.abs(a - b) % 360
    return F.when(d > 180, 360 - d).otherwise(d)


def signed_turn(before: Column, after: Column) -> Column:
    """In [-180, 180); below zero is left."""
    return F.pmod(after - before + 540, F.lit(360.0)) - 180


def offset_point(lat: Column, lon: Column, angle: Column, metres: Column) -> Column:
    d, t, a = metres / EARTH_RADIUS_M, F.radians(angle), F.radians(lat)
    to = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(t))
    side = F.atan2(F.sin(t) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(to))
    return F.struct(F.degrees(to).alias("lat"), (lon + F.degrees(side)).alias("lon"))


def project_to_segment(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Nearest point of a segment: struct(lat, lon, t in [0, 1], dist in metres)."""
    k = F.cos(F.radians((lat1 + lat2) / 2))
    dx, dy = (lon2 - lon1) * k, lat2 - lat1
    square = dx * dx + dy * dy
    t = F.when(square == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((lon - lon1) * k * dx + (lat - lat1) * dy) / square)))
    at_lat, at_lon = lat1 + t * (lat2 - lat1), lon1 + t * (lon2 - lon1)
    return F.struct(at_lat.alias("lat"), at_lon.alias("lon"), t.alias("t"), haversine(lat, lon, at_lat, at_lon).alias("dist"))


def radius_for_target(miles: Column) -> Column:
    return F.least(F.lit(16000.0), F.greatest(F.lit(900.0), miles * METRES_PER_MILE * 0.62))


def turn_kind(angle: Column, same_way: Column) -> Column:
    """straight, slight, turn or sharp; a first step and a step on the same way are straight."""
    a = F.when(same_way | angle.isNull(), 0.0).otherwise(angle)
    return F.when(a < 25, "straight").when(a < 45, "slight").when(a < 120, "turn").otherwise("sharp")
