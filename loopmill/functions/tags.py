"""Rules on the tags of map elements. `tags` is a map column; an absent and an empty tag are alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tag values of the map data.
TRAIL_HIGHWAYS = ["path", "track", "footway", "pedestrian", "cycleway"]
TRAIL_SURFACES = ["dirt", "unpaved", "ground", "gravel", "fine_gravel", "grass", "wood", "woodchips", "earth", "mud", "sand", "natural"]
BUSY_HIGHWAYS = ["primary", "secondary", "trunk", "primary_link", "secondary_link", "trunk_link"]
JUNK_SERVICES = ["parking_aisle", "driveway", "drive-through", "bus"]
CLOSED = ["no", "private"]
RUNNABLE_HIGHWAYS = ["residential", "living_street", "unclassified", "tertiary", "tertiary_link", "secondary", "secondary_link", "primary", "primary_link", "pedestrian", "footway", "path", "track", "cycleway", "service", "steps"]


def tag(tags: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(tags, F.lit(key)), F.lit(""))


def is_busy(tags: Column) -> Column:
    return tag(tags, "highway").isin(BUSY_HIGHWAYS)


def has_safe_crossing(tags: Column) -> Column:
    h = tag(tags, "highway")
    return h.isin("traffic_signals", "stop") | ((h == "crossing") & (tag(tags, "crossing") == "traffic_signals"))


def is_junk_service(tags: Column) -> Column:
    return (tag(tags, "highway") == "service") & (tag(tags, "service").isin(JUNK_SERVICES) | (tag(tags, "name") == ""))


def is_trail(tags: Column) -> Column:
    return tag(tags, "highway").isin(TRAIL_HIGHWAYS) | tag(tags, "surface").isin(TRAIL_SURFACES)


def is_accessible(tags: Column) -> Column:
    return ~(tag(tags, "access").isin(CLOSED) & (tag(tags, "foot") == "")) & ~tag(tags, "foot").isin(CLOSED)


def display_name(tags: Column) -> Column:
    name = tag(tags, "name")
    return F.when(name != "", name).when(is_trail(tags), "Unnamed trail").otherwise("Unnamed road")


def is_kept(tags: Column) -> Column:
    return is_accessible(tags) & ~is_junk_service(tags)
