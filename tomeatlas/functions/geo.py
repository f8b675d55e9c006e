"""Coordinates: parsing, distance, validity, grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomeatlas.functions.expr import ColumnLike, col, text
from tomeatlas.functions.text import NUMBER

# Sphere radii used for metres and for kilometres, null-island width in degrees.
EARTH_M = 6_371_000.0
EARTH_KM = 6371.0
NULL_ISLAND = 0.01

_POINT = rf"^Point\(\s*({NUMBER})\s+({NUMBER})\s*\)$"


def parse_point(c: ColumnLike) -> Column:
    """``struct(lon, lat)`` of "Point(lon lat)", null when malformed."""
    lon = F.regexp_extract(text(c), _POINT, 1).try_cast("double")
    lat = F.regexp_extract(text(c), _POINT, 2).try_cast("double")
    return F.when(lon.isNotNull() & lat.isNotNull(), F.struct(lon.alias("lon"), lat.alias("lat")))


def half_chord(lon1: ColumnLike, lat1: ColumnLike, lon2: ColumnLike, lat2: ColumnLike) -> Column:
    """Squared half chord of the great circle; grows with distance, so it orders like distance."""
    lon1, lat1, lon2, lat2 = col(lon1), col(lat1), col(lon2), col(lat2)
    s1 = F.sin(F.radians(lat2 - lat1) / 2)
    s2 = F.sin(F.radians(lon2 - lon1) / 2)
    return s1 * s1 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s2 * s2


def haversine(
    lon1: ColumnLike, lat1: ColumnLike, lon2: ColumnLike, lat2: ColumnLike, radius: float = EARTH_M
) -> Column:
    a = half_chord(lon1, lat1, lon2, lat2)
    return F.lit(2 * radius) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(1.0) - a, F.lit(0.0))))


def in_range(lon: ColumnLike = "lon", lat: ColumnLike = "lat") -> Column:
    return F.coalesce(col(lon).between(-180, 180) & col(lat).between(-90, 90), F.lit(False))


def is_null_island(lon: ColumnLike = "lon", lat: ColumnLike = "lat") -> Column:
    near = (F.abs(col(lon)) < NULL_ISLAND) & (F.abs(col(lat)) < NULL_ISLAND)
    return F.coalesce(near, F.lit(False))


def coord_status(lon: ColumnLike = "lon", lat: ColumnLike = "lat") -> Column:
    return (
        F.when(col(lon).isNull() | col(lat).isNull(), F.lit("missing"))
        .when(~in_range(lon, lat), F.lit("out_of_range"))
        .when(is_null_island(lon, lat), F.lit("null_island"))
        .otherwise(F.lit("ok"))
    )


def grid_cell(c: ColumnLike, degrees: float) -> Column:
    return F.floor(col(c) / F.lit(float(degrees)))


def lon_cells(degrees: float) -> int:
    """Number of grid columns around the globe, each at least ``degrees`` wide and all equal."""
    return max(int(360.0 / degrees), 1)


def wrapped_lon_cell(lon: ColumnLike, degrees: float) -> Column:
    """Grid column counted from the antimeridian, so that both sides of it meet."""
    n = lon_cells(degrees)
    return F.pmod(F.floor((col(lon) + 180.0) / F.lit(360.0 / n)), F.lit(n))


def neighbour_cells(lon: ColumnLike, lat: ColumnLike, radius_m: float | Column, degrees: float) -> Column:
    """Array of ``struct(cx, cy)`` that covers the circle of ``radius_m``, a number or a column, around a point.

    The longitude span widens with latitude and takes the whole ring where the circle reaches a
    pole; columns wrap at the antimeridian.
    """
    lon, lat = col(lon), col(lat)
    n = lon_cells(degrees)
    width = 360.0 / n
    given = isinstance(radius_m, Column)
    dlat = (F.degrees(radius_m / EARTH_M) if given else math.degrees(radius_m / EARTH_M)) * 1.000001 + 1e-9
    low, high = F.greatest(lat - dlat, F.lit(-90.0)), F.least(lat + dlat, F.lit(90.0))
    # half width of the circle's bounding box in longitude: asin(sin(r) / cos(lat))
    sine = F.sin(F.least(F.radians(dlat), F.lit(math.pi / 2))) if given else F.lit(math.sin(min(math.radians(dlat), math.pi / 2)))
    ratio = sine / F.cos(F.radians(lat))
    polar = (F.abs(lat) + dlat >= 90.0) | (ratio >= 1.0)
    dlon = F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * 1.000001 + 1e-9
    first = F.floor((lon - dlon + 180.0) / width)
    last = F.floor((lon + dlon + 180.0) / width)
    ring = F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))
    span = F.when(polar | (last - first + 1 >= n), ring).otherwise(F.sequence(first, last))
    columns = F.array_distinct(F.transform(span, lambda x: F.pmod(x, F.lit(n))))
    rows = F.sequence(F.floor(low / degrees), F.floor(high / degrees))
    return F.flatten(
        F.transform(columns, lambda x: F.transform(rows, lambda y: F.struct(x.alias("cx"), y.alias("cy"))))
    )
