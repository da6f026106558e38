"""Distances and reproducible map positions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import hash_slot

EARTH_RADIUS_KM = 6371.0088
KM_PER_DEGREE = math.pi * EARTH_RADIUS_KM / 180.0
JITTER_SLOTS = 300_000


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; the argument of ``asin`` is clamped against rounding."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


def jitter(key: Column, salt: str, spread: float = 0.3) -> Column:
    """Offset in ``[-spread/2, spread/2)`` fixed by key and salt, whatever the row order."""
    slot = hash_slot(F.concat(key.cast("string"), F.lit(salt)), JITTER_SLOTS)
    return slot.cast("double") / JITTER_SLOTS * spread - spread / 2


class Grid:
    """Latitude/longitude cells of about ``km`` at the equator, for finding all points within ``km``.

    Meridians come together towards the poles, so the cells around a place reach as many columns to either
    side as its latitude needs, all of them where a pole is within reach. Columns wrap at the date line because
    their width divides 360 degrees.
    """

    def __init__(self, km: float):
        self.lat_step = km / KM_PER_DEGREE
        self.lon_cells = max(1, math.floor(360.0 / self.lat_step))
        self.lon_step = 360.0 / self.lon_cells

    def row(self, lat: Column) -> Column:
        return F.floor(lat / self.lat_step).cast("bigint")

    def col(self, lon: Column) -> Column:
        return F.pmod(F.floor((lon + 180.0) / self.lon_step).cast("bigint"), F.lit(self.lon_cells).cast("bigint"))

    def neighbours(self, lat: Column, lon: Column) -> Column:
        """Array of the ``(cell_row, cell_col)`` that can hold points within ``km`` of a point, without repeats."""
        half = math.radians(self.lat_step)
        widest = F.sin(F.lit(half)) / F.cos(F.radians(lat))
        # Beyond the point where the circle touches a meridian; a trifle is added against rounding.
        reach = F.when(F.abs(lat) + self.lat_step >= 89.999, F.lit(180.0)).otherwise(
            F.degrees(F.asin(F.least(F.lit(1.0), widest))) + 1e-9)
        columns = F.least(F.ceil(reach / self.lon_step).cast("bigint"), F.lit(self.lon_cells // 2 + 1).cast("bigint"))
        wrapped = lambda c: F.pmod(self.col(lon) + c, F.lit(self.lon_cells).cast("bigint"))
        rows = F.sequence(F.lit(-1).cast("bigint"), F.lit(1).cast("bigint"))
        cells = F.flatten(F.transform(rows, lambda r: F.transform(
            F.sequence(-columns, columns),
            lambda c: F.struct((self.row(lat) + r).alias("cell_row"), wrapped(c).alias("cell_col")))))
        return F.array_distinct(cells)


def cell_of(level: int, lat: Column, lon: Column) -> list[Column]:
    """``row`` and ``col`` of a position in cells of 180 / 2**level degrees."""
    cells = 1 << level
    row = F.least(F.floor((lat + 90.0) * cells / 180.0), F.lit(cells - 1)).cast("int")
    col = F.floor(F.pmod(lon + 180.0, F.lit(360.0)) * cells / 180.0)
    return [row.alias("row"), F.least(col, F.lit(2 * cells - 1)).cast("int").alias("col")]


def _nearest_in_cell(lat: Column, lon: Column, south: Column, west: Column, width: float) -> Column:
    """Least distance from a position to a cell.

    Where the position's meridian crosses the cell, the nearest point is on it; else it is on one of the two sides,
    at the latitude where a great circle meets the side at a right angle, or at an end of the side.
    """
    north = south + width
    clamp = lambda x: F.least(north, F.greatest(south, x))
    inside = F.pmod(lon - west, F.lit(360.0)) <= width

    def side(meridian: Column) -> Column:
        apart = F.radians(meridian - lon)
        foot = F.degrees(F.atan2(F.sin(F.radians(lat)), F.cos(F.radians(lat)) * F.cos(apart)))
        return F.least(*[haversine_km(lat, lon, y, meridian) for y in (clamp(foot), south, north)])

    return F.when(inside, haversine_km(lat, lon, clamp(lat), lon)).otherwise(F.least(side(west), side(west + width)))


def cell_distances(level: int, lat: Column, lon: Column, row: Column, col: Column) -> tuple[Column, Column]:
    """Bounds of the distances in km from a position to the points of a cell, a trifle wide against rounding.

    The farthest point of the cell is the nearest one to the position's antipode.
    """
    width = 180.0 / (1 << level)
    south, west = row * width - 90.0, col * width - 180.0
    near = _nearest_in_cell(lat, lon, south, west, width)
    far = F.lit(math.pi * EARTH_RADIUS_KM) - _nearest_in_cell(-lat, lon + 180.0, south, west, width)
    return near - 1e-4, far + 1e-4


def cell_radius(lat: Column, width: float) -> Column:
    """Greatest distance in km of a point of a cell from its middle at ``lat``, a trifle wide against rounding.

    No longer than the straight way on the map, on which a degree of longitude is widest at the side near the equator.
    """
    widest = F.cos(F.radians(F.greatest(F.lit(0.0), F.abs(lat) - width / 2)))
    return F.sqrt(1 + widest * widest) * (KM_PER_DEGREE * width / 2) + 1e-4
