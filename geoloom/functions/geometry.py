"""Geometry as column expressions. lat and lon are degrees, mx and my Mercator metres."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Radii in metres, and the latitude in radians beyond which Mercator is clamped.
MERCATOR_RADIUS = 6378137.0
EARTH_RADIUS = 6371000.0
MOST_LATITUDE = 1.48352986419518


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    a = F.least(F.lit(1.0), a)
    return F.lit(2 * EARTH_RADIUS) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def mercator_x(lon: Column) -> Column:
    return F.lit(MERCATOR_RADIUS) * F.radians(lon)


def mercator_y(lat: Column) -> Column:
    phi = F.greatest(F.lit(-MOST_LATITUDE), F.least(F.lit(MOST_LATITUDE), F.radians(lat)))
    return F.lit(MERCATOR_RADIUS) * F.ln(F.tan(F.pi() / 4 + phi / 2))


def euclidean(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def degree_distance2(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Squared distance in raw degrees: what nearest objects are chosen by."""
    return (lat2 - lat1) * (lat2 - lat1) + (lon2 - lon1) * (lon2 - lon1)


def distance_to_box(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Squared distance from a point to a closed box; 0 inside."""
    dx = F.greatest(x0 - x, F.lit(0.0), x - x1)
    dy = F.greatest(y0 - y, F.lit(0.0), y - y1)
    return dx * dx + dy * dy


def in_box(lat: Column, lon: Column, sw_lat: Column, sw_lon: Column, ne_lat: Column, ne_lon: Column) -> Column:
    return lat.between(sw_lat, ne_lat) & lon.between(sw_lon, ne_lon)
