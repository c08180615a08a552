"""Rounding dialects in one place."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def tidy(x: Column | str, digits: int = 6) -> Column:
    """A double rounded for output, ties away from zero, in binary arithmetic; adding 0.0 removes negative zero."""
    x, scale = F.col(x).cast("double") if isinstance(x, str) else x.cast("double"), F.lit(10.0**digits)
    return F.signum(x) * (F.floor(F.abs(x) * scale + 0.5) / scale) + F.lit(0.0)


def half_even(x: Column | str, digits: int = 0) -> Column:
    """Ties go to the even neighbour."""
    return F.bround(x, digits)


def half_up(x: Column) -> Column:
    """Ties go towards plus infinity."""
    return F.floor(x + 0.5)


def clamp(x: Column, low: float, high: float) -> Column:
    """x within bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))
