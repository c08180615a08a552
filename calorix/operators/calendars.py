"""Holidays, occupancy and setpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Days before each month in a 365-day year.
DAYS_BEFORE = (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)
# Holiday ranges (month, day) to (month, day), inclusive; a range that ends before it starts wraps the year.
HOLIDAYS = {
    "all": (((10, 19), (11, 3)), ((12, 21), (1, 5)), ((7, 5), (8, 31))),
    "A": (((2, 22), (3, 9)), ((4, 19), (5, 4))),
    "B": (((2, 8), (2, 23)), ((4, 5), (4, 20))),
    "C": (((2, 15), (3, 2)), ((4, 12), (4, 27))),
}
# Profile: closes in vacations, closes at weekends, highest day temperature.
PROFILES = {"school": (True, True, 100.0), "school_ac": (True, True, 26.0), "office": (False, True, 100.0), "office_ac": (False, True, 26.0), "home": (False, False, 100.0), "home_ac": (False, False, 26.0)}
DAY_HOURS = (7, 19)
SETPOINTS = {"day": 19.0, "reduced": 16.0, "frost": 7.0, "off": 100.0}


def year_day(month: int, day: int) -> int:
    """Day of a 365-day year, from 1."""
    return DAYS_BEFORE[month - 1] + day


def holiday_days(spark: SparkSession, zone: str) -> DataFrame:
    """Distinct holiday days of a zone, those of all zones included."""
    rows = []
    for start, end in HOLIDAYS["all"] + HOLIDAYS.get(zone, ()):
        a, b = year_day(*start), year_day(*end)
        rows += [(a, b)] if a <= b else [(a, 365), (1, b)]
    return spark.createDataFrame(rows, "a int, b int").select(F.explode(F.sequence("a", "b")).alias("day")).distinct()


def runs(days: DataFrame, day: str = "day", by: tuple[str, ...] = ()) -> DataFrame:
    """First and last day of every run of consecutive days."""
    island = F.col(day) - F.row_number().over(Window.partitionBy(*by).orderBy(day))
    return days.withColumn("__g", island).groupBy(*by, "__g").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day")).drop("__g")


def in_ranges(days: DataFrame, ranges: DataFrame, day: str) -> DataFrame:
    """Days that lie in any of a few ranges."""
    return days.join(F.broadcast(ranges), F.col(day).between(F.col("first_day"), F.col("last_day")), "left_semi")  # ranges of one year


def closed(profile: str, vacation: Column, weekday: Column) -> Column:
    """Whether a profile is closed on a day; weekday 0 is Monday."""
    in_vacation, at_weekend, _ = PROFILES[profile]
    return (F.lit(in_vacation) & vacation) | (F.lit(at_weekend) & (weekday >= 5))


def setpoints(profile: str, shut: Column, hour: Column) -> tuple[Column, Column]:
    """Lowest and highest temperature of an hour."""
    day = (hour >= DAY_HOURS[0]) & (hour < DAY_HOURS[1])
    low = F.when(shut, SETPOINTS["frost"]).when(day, SETPOINTS["day"]).otherwise(SETPOINTS["reduced"])
    high = F.when(~shut & day, PROFILES[profile][2]).otherwise(SETPOINTS["off"])
    return low, high
