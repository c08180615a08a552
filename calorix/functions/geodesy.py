"""Local projections and boxes on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_M = 6378137.0
# Boxes (south, north, west, east) of the country's parts.
COUNTRY_BOXES = (
    (41.0, 51.5, -5.5, 9.8),
    (15.8, 16.6, -61.9, -60.9),
    (14.3, 15.0, -61.3, -60.7),
    (2.0, 6.0, -54.7, -51.5),
    (-21.5, -20.7, 55.0, 55.9),
    (-13.1, -12.5, 44.9, 45.4),
)


def half_box(lat: Column, radius_m: Column | float) -> tuple[Column, Column]:
    """Half height and half width, in degrees, of the box around a circle."""
    r = radius_m if isinstance(radius_m, Column) else F.lit(float(radius_m))
    return F.degrees(r / RADIUS_M), F.degrees(r / (F.lit(RADIUS_M) * F.cos(F.radians(lat))))


def project(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Metres east and north of an origin."""
    return F.radians(lon - lon0) * RADIUS_M * F.cos(F.radians(lat0)), F.radians(lat - lat0) * RADIUS_M


def unproject(x: Column, y: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Latitude and longitude of metres east and north of an origin."""
    return lat0 + F.degrees(y / RADIUS_M), lon0 + F.degrees(x / (F.lit(RADIUS_M) * F.cos(F.radians(lat0))))


def rotate(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    """Point turned by an angle in degrees; exactly unchanged at 0."""
    c, s = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    return F.when(angle == 0, x).otherwise(x * c - y * s), F.when(angle == 0, y).otherwise(x * s + y * c)


def in_country(lat: Column, lon: Column) -> Column:
    """Whether a point is in any of the country's boxes, edges included."""
    inside = F.lit(False)
    for south, north, west, east in COUNTRY_BOXES:
        inside = inside | (lat.between(south, north) & lon.between(west, east))
    return inside
