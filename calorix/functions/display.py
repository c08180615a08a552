"""Calendar arithmetic, derived schedules and presentation values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calorix.functions.physics import AIR_J_PER_M3_K
from calorix.functions.rounding import half_up

CLOSED_FLOW = 0.15
# Air changes per hour and heat recovery of the ventilation profiles.
VENTILATION = ((1.2, 0.0), (0.8, 0.0), (0.6, 0.0), (0.5, 0.0), (0.5, 0.75))


def hour_parts(hour: Column, first_weekday: Column) -> tuple[Column, Column, Column]:
    """Day number, weekday (0 is Monday) and hour of day of an absolute hour, which may be negative."""
    day = F.floor(hour / 24)
    return day, F.pmod(day + first_weekday, F.lit(7)), F.pmod(hour, F.lit(24))


def air_capacity(volume: Column) -> Column:
    """J/K of an air volume."""
    return AIR_J_PER_M3_K * volume


def air_flow(volume: Column, changes: Column) -> Column:
    """m3/h of air changes, rounded half up to a tenth."""
    return half_up(volume * changes * 10.0) / 10.0


def per_area(value: Column, area: Column) -> Column:
    """Value per reference area; null if the area is unknown or zero."""
    return value / F.nullif(area, F.lit(0.0))


def closed_schedule(opened: DataFrame) -> DataFrame:
    """The schedule of closed days: a share of the flow, no gains, shutters as they are."""
    return opened.withColumns({"debit": F.col("debit") * CLOSED_FLOW, "gains": F.lit(0.0)})


def suggested_flow(volume: Column, profile: int) -> tuple[Column, Column]:
    """Air flow (m3/h) and heat recovery of a ventilation profile for a volume."""
    changes, recovery = VENTILATION[profile]
    return air_flow(volume, F.lit(changes)), F.lit(recovery)


def days_ago(n: int, today: Column | None = None) -> Column:
    """The date n days before today, as text."""
    return F.date_format(F.date_sub(today if today is not None else F.current_date(), n), "yyyy-MM-dd")


# The service's own texts, in its language.
NAME_PATTERN = "Bâtiment %.5f, %.5f"
HOURS_READ, HOURS_SKIPPED = "%d heure(s) récupérée(s) (%s).", "%d heure(s) ignorée(s), donnée manquante."


def default_name(lat: Column, lon: Column) -> Column:
    """Label of a building without a name."""
    return F.format_string(NAME_PATTERN, lat, lon)


def stem(path: Column) -> Column:
    """File name without a mesh extension."""
    return F.regexp_replace(path, r"(?i)\.(obj|stl)$", "")


def weather_message(hours: Column, source: Column, warning: Column, missing: Column) -> Column:
    """What became of a weather request, in the words of the service."""
    name = F.when(source == "pvgis-tmy", "PVGIS TMY").otherwise("Open-Meteo Archive")
    base = F.format_string(HOURS_READ, hours.cast("int"), name)
    skipped = F.when(missing > 0, F.format_string(HOURS_SKIPPED, missing.cast("int")))
    return F.concat_ws(" ", base, warning, skipped)


def domain(low: Column, high: Column, share: float) -> tuple[Column, Column]:
    """Ends of a chart's axis: the values' range widened by a share of it, by 1 where all are equal, 0 to 1 without values."""
    spread = F.when(high > low, (high - low) * share).otherwise(F.lit(1.0 if share >= 0.1 else 1.0 + 2.0 * share))
    return F.coalesce(low - spread, F.lit(0.0)), F.coalesce(high + spread, F.lit(1.0))


def nearest_hour(x: Column, left: Column, width: Column, hours: Column) -> Column:
    """The hour under a chart position, rounded half up; null outside the chart."""
    hour = half_up((x - left) / width * hours)
    return F.when(hour.between(0, hours), hour)


def shared_groups(own: Column, required: Column) -> Column:
    """Groups that two lists have in common, in order."""
    return F.array_sort(F.array_intersect(own, required))


def ramp(value: Column, low: Column, high: Column, start: str, end: str) -> Column:
    """Colour between two hex colours by a value's place between low and high."""
    share = F.when(high > low, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))).otherwise(0.0)
    parts = []
    for i in (1, 3, 5):
        a, b = int(start[i : i + 2], 16), int(end[i : i + 2], 16)
        parts.append(F.lower(F.lpad(F.hex(half_up(F.lit(float(a)) + share * float(b - a)).cast("long")), 2, "0")))
    return F.concat(F.lit("#"), *parts)


def ticks(low: Column, high: Column, n: int) -> Column:
    """n + 1 evenly spaced values from low to high."""
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: low + (high - low) * i / float(n))


def sample_entities(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Three departments and three members to start with."""
    departments = spark.createDataFrame([(1, "Energy", ""), (2, "Structures", ""), (3, "Materials", "")], "id long, name string, description string")
    users = spark.createDataFrame([("a@example.org", "A", 1), ("b@example.org", "B", 2), ("c@example.org", "C", None)], "email string, display_name string, department_id long")
    return departments, users
