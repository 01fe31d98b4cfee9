"""Text rules for addresses and documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def xml_escape(x: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(raw), F.lit(name))
    return x


def normalize_query(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(x)), r"\s+", " ")


def has_house_number(x: Column) -> Column:
    return x.rlike(r"(?i)^\s*\d+[a-z]?\b")


def suggestion_label(number: Column, street: Column, name: Column, city: Column, county: Column, state: Column, country: Column) -> Column:
    """Street with its number (else the name), then the city if it says more (else the county), state, and the country where
    neither city nor county is known. Empty parts are left out; a label of nothing is empty."""
    number, street, name, city, county, state, country = (F.nullif(x, F.lit("")) for x in (number, street, name, city, county, state, country))
    head = F.when(number.isNotNull() & street.isNotNull(), F.concat_ws(" ", number, street)).otherwise(F.coalesce(street, name))
    town = F.when(city.isNotNull() & ~city.eqNullSafe(head), city).otherwise(county)
    land = F.when(city.isNull() & county.isNull(), country)
    return F.concat_ws(", ", head, town, state, land)
