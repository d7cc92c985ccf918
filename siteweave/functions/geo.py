"""Coordinates, tiles and great-circle distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088  # mean radius


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def tile_centre(v: Column) -> Column:
    """Centre of the 0.1-degree tile that holds the coordinate."""
    return F.round(F.floor(v * 10) / 10.0 + 0.05, 2)


def metric_block(lat: Column, lon: Column, metres: float) -> Column:
    """struct(bx, by): the square of a local metric grid."""
    r = EARTH_KM * 1000
    return F.struct(F.floor(F.radians(lon) * r * F.cos(F.radians(lat)) / metres).alias("bx"), F.floor(F.radians(lat) * r / metres).alias("by"))


def utm_zone(lon: Column) -> Column:
    return F.least(F.lit(60), F.floor((lon + 180) / 6).cast("int") + 1)


def utm_epsg(lat: Column, lon: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)


def to_row(y: Column, top: float, size: float) -> Column:
    return F.floor((F.lit(top) - y) / size)


def to_col(x: Column, left: float, size: float) -> Column:
    return F.floor((x - F.lit(left)) / size)


def to_x(col: Column, left: float, size: float) -> Column:
    return F.lit(left) + (col + 0.5) * size


def to_y(row: Column, top: float, size: float) -> Column:
    return F.lit(top) - (row + 0.5) * size


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a polygon of an edge array (struct x1, y1, x2, y2) by the even-odd rule; several rings may share the array."""
    def crossings(n, e):
        at = F.try_divide((e["x2"] - e["x1"]) * (y - e["y1"]), e["y2"] - e["y1"]) + e["x1"]
        return n + F.when(((e["y1"] > y) != (e["y2"] > y)) & (x < at), 1).otherwise(0)

    return F.aggregate(ring, F.lit(0), crossings) % 2 == 1
