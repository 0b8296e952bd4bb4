"""What map tags (MAP<STRING, STRING>) say about an object, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import house_number


def has(tags: Column, *keys: str) -> Column:
    found = F.lit(False)
    for key in keys:
        found = found | F.coalesce(F.map_contains_key(tags, F.lit(key)), F.lit(False))
    return found


def is_building(tags: Column) -> Column:
    return has(tags, "building", "shop", "amenity")


def is_street(tags: Column) -> Column:
    return has(tags, "highway")


def is_admin_area(tags: Column) -> Column:
    return F.coalesce(tags["boundary"] == "administrative", F.lit(False))


def street_name(tags: Column) -> Column:
    return F.coalesce(tags["addr:street:de"], tags["addr:street"])


def shop_name(tags: Column) -> Column:
    return F.coalesce(tags["name:de"], tags["name"], tags["brand:de"], tags["brand"])


def object_name(tags: Column) -> Column:
    return F.coalesce(tags["name:de"], tags["name"])


def tagged_house_number(tags: Column) -> Column:
    return house_number(tags["addr:housenumber"])


def admin_level(tags: Column) -> Column:
    """Leading integer of admin_level (white space and a sign may come first) from 0 to 255, else null."""
    number = F.regexp_extract(tags["admin_level"], r"^[ \t\n\x0B\f\r]*([+-]?[0-9]+)", 1).try_cast("int")
    return F.when(number.between(0, 255), number)
