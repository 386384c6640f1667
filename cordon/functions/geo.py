"""Distances on the sphere and grid cells, all as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0
KM_PER_DEG = RADIUS_KM * math.pi / 180.0


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle kilometres."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    a = (
        F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
        + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    )
    a = F.when(a > 1.0, 1.0).otherwise(a)  # rounding may pass one; null stays null
    return F.lit(2 * RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def segment_km(plat, plon, alat, alon, blat, blon) -> Column:
    """Kilometres from a point to a segment: the foot point is found on the flat
    degree plane, its distance on the sphere."""
    plat, plon, alat, alon, blat, blon = map(_c, (plat, plon, alat, alon, blat, blon))
    dx, dy = blat - alat, blon - alon
    norm = dx * dx + dy * dy
    t = F.when(norm == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((plat - alat) * dx + (plon - alon) * dy) / F.nullif(norm, F.lit(0.0))))
    )
    return haversine(plat, plon, alat + t * dx, alon + t * dy)


def lat_cell(lat, km: float) -> Column:
    """Row of the grid whose rows are ``km`` high."""
    return F.floor(_c(lat) / F.lit(km / KM_PER_DEG)).cast("int")


def lon_step(row: Column, km: float) -> Column:
    """Degrees of longitude that span at least ``km`` anywhere in a grid row,
    widened for the row's own height so neighbours in longitude stay neighbours."""
    step = km / KM_PER_DEG
    top = F.greatest(F.abs(row * F.lit(step)), F.abs((row + 1) * F.lit(step)))
    return F.lit(step) / F.greatest(F.cos(F.radians(F.least(top + F.lit(step), F.lit(89.0)))), F.lit(0.0175))


def lon_cell(lon, row: Column, km: float) -> Column:
    return F.floor(_c(lon) / lon_step(row, km)).cast("int")


def nearby_cells(lat, lon, km: float) -> Column:
    """Cells that can hold a point within ``km`` of the given one: in each of
    the three rows that can be reached, the columns its longitude span touches."""
    row = lat_cell(lat, km)

    def columns(r):
        step = lon_step(r, km)
        mid = F.floor(_c(lon) / step).cast("int")
        return F.transform(
            F.sequence(mid - 1, mid + 1), lambda c: F.struct(r.alias("cy"), c.alias("cx"))
        )

    return F.flatten(F.transform(F.sequence(row - 1, row + 1), columns))
