"""Points, distances and polygons as plain Column expressions (degrees, metres).

A polygon is an ``array<struct<lon, lat>>``, its ring not repeated at the end.
Poles and the antimeridian are out of scope.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371010.0
METRES_PER_DEGREE = EARTH_RADIUS_M * math.pi / 180.0


def distance_m(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    """Great-circle distance on a sphere, by the haversine formula."""
    half_lat = F.sin(F.radians(lat_b - lat_a) / 2)
    half_lon = F.sin(F.radians(lon_b - lon_a) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))


def in_polygon(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd rule: an eastward ray from the point crosses the ring an odd number of times.

    Edges are half open in latitude, so a point on a shared edge belongs to one side only.
    """

    def crosses(corner: Column, position: Column) -> Column:
        following = F.get(ring, (position + 1) % F.size(ring))
        spans = (corner["lat"] > lat) != (following["lat"] > lat)
        share = F.try_divide(lat - corner["lat"], following["lat"] - corner["lat"])
        return spans & (lon < corner["lon"] + share * (following["lon"] - corner["lon"]))

    return F.size(F.filter(ring, crosses)) % 2 == 1


def ring_bounds(ring: Column) -> tuple[Column, Column, Column, Column]:
    """West, south, east and north limit of a ring."""
    lons = F.transform(ring, lambda p: p["lon"])
    lats = F.transform(ring, lambda p: p["lat"])
    return F.array_min(lons), F.array_min(lats), F.array_max(lons), F.array_max(lats)


def cell(degrees: Column, size: float) -> Column:
    """Index of the grid strip a coordinate falls in."""
    return F.floor(degrees / F.lit(size)).cast("int")
