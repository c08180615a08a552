"""Triangle geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]
DEGENERATE = 1e-12


def minus(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b))


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def corner(i: int, prefix: str = "") -> Vector:
    """The i-th corner from columns x0..z2."""
    return tuple(F.col(f"{prefix}{c}{i}") for c in "xyz")


def tilt(nz: Column) -> Column:
    """Angle of a unit normal from the vertical, in degrees."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), nz))))


def hit_distance(origin: Vector, ray: Vector, a: Vector, b: Vector, c: Vector) -> Column:
    """Distance along a ray to a triangle, null without a hit (barycentric test by three determinants)."""
    e1, e2, t = minus(b, a), minus(c, a), minus(origin, a)
    p, q = cross(ray, e2), cross(t, e1)
    det = dot(e1, p)
    u, v, w = dot(t, p) / det, dot(ray, q) / det, dot(e2, q) / det
    return F.when((F.abs(det) > 1e-12) & (u >= 0) & (v >= 0) & (u + v <= 1) & (w > 1e-9), w)
