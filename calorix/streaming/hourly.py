"""Hourly weather from an unbounded stream of observations (an extension: batch and stream give the same rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_channels(events: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Channels per hour; an hour is emitted once the watermark has passed it, later observations are dropped."""
    of = lambda kind: F.when(F.col("event_type") == kind, F.col("value"))
    hours = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness).groupBy(F.window("at", "1 hour"))
    return hours.agg(
        (F.avg(of("view")) - 40.0).alias("t_ext_raw"), (F.sum(of("purchase")) * 8.0).alias("e_dir_raw"), (F.avg(of("click")) * 4.0).alias("e_dif_raw"), (F.avg(of("error")) / 10.0).alias("wind_raw"),
    ).select(F.col("window.start").alias("hour_ts"), "t_ext_raw", "e_dir_raw", "e_dif_raw", "wind_raw")
