"""Position of the sun as column expressions (degrees; azimuth clockwise from north)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Coefficients of the published 1971 Fourier series.
DECLINATION = {"cos0": 0.006918, "cos1": -0.399912, "sin1": 0.070257, "cos2": -0.006758, "sin2": 0.000907, "cos3": -0.002697, "sin3": 0.00148}
EQUATION_OF_TIME = {"cos0": 0.000075, "cos1": 0.001868, "sin1": -0.032077, "cos2": -0.014615, "sin2": -0.040849}
MINUTES_PER_RADIAN = 229.18


def day_angle(ts: Column) -> Column:
    """Angle of the day in the year, in radians."""
    return F.lit(2 * math.pi) * (F.dayofyear(ts) - 1) / F.lit(365.0)


def series(angle: Column, terms: dict[str, float]) -> Column:
    """Sum of harmonics named like cos2 or sin1."""
    total = F.lit(0.0)
    for name, factor in terms.items():
        n = int(name[3:])
        wave = F.lit(1.0) if n == 0 else (F.cos if name.startswith("cos") else F.sin)(angle * n)
        total = total + F.lit(factor) * wave
    return total


def declination(angle: Column) -> Column:
    """Declination in degrees."""
    return F.degrees(series(angle, DECLINATION))


def equation_of_time(angle: Column) -> Column:
    """Apparent minus mean solar time in minutes."""
    return F.lit(MINUTES_PER_RADIAN) * series(angle, EQUATION_OF_TIME)


def hour_angle(ts: Column, lon: Column) -> Column:
    """Hour angle in degrees at a UTC instant."""
    minutes = F.hour(ts) * 60.0 + F.minute(ts) + F.second(ts) / 60.0
    return (minutes + equation_of_time(day_angle(ts)) + lon * 4.0) / 4.0 - 180.0


def hour_terms(ts: Column) -> dict[str, Column]:
    """What the sun's position needs of an instant, wherever the site: declination (degrees) and solar minutes at longitude 0."""
    angle = day_angle(ts)
    return {"declination": declination(angle), "solar_minutes": F.hour(ts) * 60.0 + F.minute(ts) + F.second(ts) / 60.0 + equation_of_time(angle)}


def degrees_of(east: Column, north: Column) -> Column:
    """Azimuth of a horizontal direction, 0 to 360."""
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def position(dec: tuple[Column, Column], phi: tuple[Column, Column], hour_angle_deg: Column) -> tuple[Column, Column]:
    """Azimuth and elevation from sine and cosine of declination and latitude, and the hour angle."""
    h = F.radians(hour_angle_deg)
    up = phi[0] * dec[0] + phi[1] * dec[1] * F.cos(h)
    east = -dec[1] * F.sin(h)
    north = dec[0] * phi[1] - dec[1] * phi[0] * F.cos(h)
    return degrees_of(east, north), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), up))))


def sun_position(ts: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """Azimuth and elevation at a UTC instant."""
    d, phi = F.radians(declination(day_angle(ts))), F.radians(lat)
    return position((F.sin(d), F.cos(d)), (F.sin(phi), F.cos(phi)), hour_angle(ts, lon))


def positions(hours: DataFrame, sites: DataFrame, ts: str = "hour_ts") -> DataFrame:
    """Every hour at every site with azimuth and elevation; the hours (of one series, a year at most) are broadcast.

    Declination and equation of time are taken once per hour, the latitude's sine
    and cosine once per site; only the hour angle is left for the pairs.
    """
    dec, phi = F.radians("declination"), F.radians("lat")
    timed = hours.withColumns(hour_terms(F.col(ts))).withColumns({"__sd": F.sin(dec), "__cd": F.cos(dec)})
    placed = sites.withColumns({"__sp": F.sin(phi), "__cp": F.cos(phi)})
    angle = (F.col("solar_minutes") + F.col("lon") * 4.0) / 4.0 - 180.0
    azimuth, elevation = position((F.col("__sd"), F.col("__cd")), (F.col("__sp"), F.col("__cp")), angle)
    return placed.crossJoin(F.broadcast(timed)).withColumns({"azimuth": azimuth, "elevation": elevation}).drop("__sd", "__cd", "__sp", "__cp")


def local_azimuth(azimuth: Column, offset: Column) -> Column:
    """Azimuth in a frame whose north is turned by the offset."""
    a, t = F.radians(azimuth), F.radians(offset)
    return degrees_of(F.sin(a) * F.cos(t) - F.cos(a) * F.sin(t), F.sin(a) * F.sin(t) + F.cos(a) * F.cos(t))


def direction(azimuth: Column, elevation: Column) -> tuple[Column, Column, Column]:
    """Unit vector towards the sun (x east, y north, z up)."""
    a, e = F.radians(azimuth), F.radians(elevation)
    return F.sin(a) * F.cos(e), F.cos(a) * F.cos(e), F.sin(e)
