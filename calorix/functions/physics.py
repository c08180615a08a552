"""Heat-transfer scalars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from calorix.functions.rounding import half_even

STEP_S = 3600.0
AIR_J_PER_M3_K = 1200.0


def film_coefficient(wind: Column) -> Column:
    """Outer film coefficient from wind rounded half-even to 1 m/s."""
    return F.when(wind.isNotNull(), 5.8 + 3.94 * F.greatest(half_even(wind), F.lit(0.0)))


def ventilation_conductance(flow: Column, recovery: Column) -> Column:
    """W/K of an air flow in m3/h with heat recovery."""
    return 0.34 * flow * (1.0 - recovery)


def inner_film(tilt_deg: Column) -> Column:
    """Inner film coefficient by tilt: floor-facing, wall, ceiling-facing."""
    return F.when(tilt_deg <= 60, 10.0).when(tilt_deg >= 120, 5.9).otherwise(7.7)


def ground_conductance(resistance: Column) -> Column:
    return 1.0 / F.greatest(resistance, F.lit(1e-6))


def with_resistance(h: Column, resistance: Column) -> Column:
    """A film in series with an added resistance."""
    return 1.0 / (1.0 / h + resistance)


def surface_film(h_e: Column, boundary: Column, r_ground: Column, closed: Column, resistance: Column) -> Column:
    """Outer film of a surface: the ground's own, else in series with the shading's resistance while it is closed."""
    return F.when(boundary == "ground", ground_conductance(r_ground)).when(F.coalesce(closed, F.lit(False)) & (resistance > 0), with_resistance(h_e, resistance)).otherwise(h_e)


def incident_on_wall(e_dir: Column, e_dif: Column, sun_height: Column, incidence_deg: Column, tilt_deg: Column) -> Column:
    """Sun on a tilted wall: direct by its incidence while the sun is up and in front, diffuse by the free sky's share."""
    cosine = F.cos(F.radians(incidence_deg))
    return e_dir * F.when((sun_height > 0) & (cosine > 0), cosine).otherwise(0.0) + e_dif * sky_view(tilt_deg)


def sky_view(tilt_deg: Column) -> Column:
    """View factor of the free sky."""
    return (1.0 + F.cos(F.radians(tilt_deg))) / 2.0
