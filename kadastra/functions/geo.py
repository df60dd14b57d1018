"""Distances, boxes and map helpers as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kadastra import constants as C


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def in_box(lat: Column, lon: Column, lat_min, lat_max, lon_min, lon_max) -> Column:
    return lat.between(lat_min, lat_max) & lon.between(lon_min, lon_max)


def in_poland(lat: Column, lon: Column) -> Column:
    return in_box(lat, lon, *C.POLAND)


def jitter(row_id: Column, lat: Column, lon: Column, precision: Column) -> tuple[Column, Column]:
    """Points that stand for a whole town or street, spread on a golden-angle spiral by id; addresses stay."""
    spread = F.when(precision == "address", 0.0).when(precision == "city", C.JITTER_SPREAD).otherwise(C.JITTER_SPREAD / 4)
    angle = F.radians(F.pmod(row_id * F.lit(C.JITTER_ANGLE), F.lit(360.0)))
    radius = spread * F.sqrt(F.pmod(row_id * 31, F.lit(100)) / 100.0)
    return lat + radius * F.cos(angle), lon + radius * F.sin(angle) * C.JITTER_LON


def price_band(price_per_m2: Column, edges: tuple[float, ...] = (6000.0, 9000.0, 12000.0, 16000.0)) -> Column:
    """Number of the map colour band of a price per square metre; -1 for none."""
    out = F.when(price_per_m2.isNull(), -1)
    for i, edge in enumerate(edges):
        out = out.when(price_per_m2 < edge, i)
    return out.otherwise(len(edges))
