"""Distances and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_M = 6_371_000


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def great_circle(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """The same by the arc cosine."""
    c = F.sin(F.radians(lat1)) * F.sin(F.radians(lat2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lng2 - lng1))
    return RADIUS_M * F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c)))


def within(lat: Column, lng: Column, south: float, west: float, north: float, east: float) -> Column:
    return lat.between(south, north) & lng.between(west, east)
