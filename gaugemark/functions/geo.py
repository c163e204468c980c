"""Distances and grid cells as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088
RES = 0.25


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda d: F.pow(F.sin(F.radians(d) / 2), F.lit(2.0))
    a = half(lat2 - lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon2 - lon1)
    return F.when(a.isNotNull(), F.asin(F.sqrt(F.least(F.lit(1.0), a))) * (2 * EARTH_RADIUS_KM))


def cell(coordinate: Column, res: float = RES) -> Column:
    return F.floor(coordinate / res).cast("int")


def tile(lat: Column, lon: Column) -> Column:
    """Name of the one-degree terrain tile whose south-west corner is below the point."""
    name = lambda x, plus, minus, digits: F.concat(F.when(x >= 0, F.lit(plus)).otherwise(F.lit(minus)), F.lpad(F.abs(F.floor(x)).cast("string"), digits, "0"))
    return F.concat(name(lat, "N", "S", 2), F.lit("_"), name(lon, "E", "W", 3))
