"""Weather series of many sites: a check per series, a fallback per site, hour indices and the sun.

Hours are rows (site, source, seq, hour_ts and the raw channels); a site prefers its
typical year and takes its archive where the typical year can't be used.  Series
are dealt out by site once: the joins with sites and all windows go by that
partitioning, and a window spans one checked series, of a year at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calorix.functions import solar
from calorix.operators.weather import MAX_HOURS, REQUIRED, clamped
from calorix.sources.stage import written

TYPICAL, ARCHIVE = "typical", "archive"
#: Sources in the order of preference.
SOURCES = (TYPICAL, ARCHIVE)


def complete() -> Column:
    """Whether an hour has its time, temperature and radiation; a missing wind keeps it."""
    ok = F.col("hour_ts").isNotNull()
    for c in REQUIRED:
        ok = ok & F.col(c).isNotNull()
    return ok


def why_not(n_hours: Column, n_kept: Column) -> Column:
    """Why a series can't be used, or null: no hours, more than a leap year's, or none complete."""
    return F.when(F.coalesce(n_hours, F.lit(0)) == 0, "no hours").when(n_hours > MAX_HOURS, F.concat(n_hours.cast("string"), F.lit(f" hours, more than {MAX_HOURS}"))).when(n_kept == 0, "no complete hour")


def report(sites: DataFrame, raw: DataFrame, key: str = "site_id") -> DataFrame:
    """One row a site: the source taken (null if none can be), its hours and those left out, and a warning if it isn't the first choice."""
    counts = raw.groupBy(key, "source").agg(F.count(F.lit(1)).alias("n"), F.count_if(complete()).alias("k"))
    of = lambda c, s: F.max(F.when(F.col("source") == s, F.col(c))).alias(f"{c}_{s}")
    by_site = sites.select(key).join(counts.groupBy(key).agg(*[of(c, s) for c in "nk" for s in SOURCES]), key, "left")
    reasons = by_site.withColumns({f"why_{s}": why_not(F.col(f"n_{s}"), F.col(f"k_{s}")) for s in SOURCES})
    taken = F.coalesce(*[F.when(F.col(f"why_{s}").isNull(), F.lit(s)) for s in SOURCES])
    chosen = reasons.withColumn("source", taken)
    pick = lambda c: F.coalesce(*[F.when(F.col("source") == s, F.col(f"{c}_{s}")) for s in SOURCES])
    failed = F.concat_ws("; ", *[F.concat(F.lit(f"{s}: "), F.col(f"why_{s}")) for s in SOURCES])
    return chosen.select(key, "source", F.coalesce(pick("n"), F.lit(0).cast("long")).alias("n_hours"), F.coalesce(pick("n") - pick("k"), F.lit(0).cast("long")).alias("n_missing"), F.nullif(failed, F.lit("")).alias("warning"))


def with_hour_index(hours: DataFrame, key: str = "site_id") -> DataFrame:
    """Hours with ``hour_index`` in local time, by ``utc_offset_s``.

    Of an archive: hours since midnight of the first kept row's day, so that missing
    days count.  Of a typical year, whose months come from different years: days
    are counted by changes of (month, day) in the order of ``seq``.
    """
    series = Window.partitionBy(key)
    rows = series.orderBy("seq")
    local = hours.withColumn("__local", F.col("hour_ts") + F.make_dt_interval(secs=F.coalesce("utc_offset_s", F.lit(0))))
    month_day = F.month("__local") * 100 + F.dayofmonth("__local")
    marked = local.withColumns({"__first": F.min(F.to_date("__local")).over(series), "__new": (~month_day.eqNullSafe(F.lag(month_day).over(rows))).cast("int")})
    day = F.when(F.col("source") == TYPICAL, F.sum("__new").over(rows) - 1).otherwise(F.datediff(F.to_date("__local"), F.col("__first")))
    return marked.withColumn("hour_index", (day * 24 + F.hour("__local")).cast("int")).drop("__local", "__first", "__new")


def assembled(sites: DataFrame, raw: DataFrame, key: str = "site_id") -> tuple[DataFrame, DataFrame]:
    """Hours of all sites that have a usable series, and the report.

    sites: key, lat, lon, north_offset_deg, utc_offset_s (null counts as 0).  Hours
    have key, source, hour_index, the clamped channels, sun_azimuth (in the site's
    frame) and sun_elevation.
    """
    told = written(report(sites, raw, key), "report")
    places = sites.join(told.select(key, F.col("source").alias("__taken")), key)
    kept = raw.where(complete()).repartition(key).join(places, key)
    # Not as an equality that Spark could join by: rows are dealt out by site alone.
    kept = kept.where(F.coalesce(F.col("source") == F.col("__taken"), F.lit(False))).drop("__taken")
    hours = clamped(with_hour_index(kept, key))
    azimuth, elevation = solar.sun_position(F.col("hour_ts"), F.col("lat"), F.col("lon"))
    hours = hours.withColumns({"sun_azimuth": solar.local_azimuth(azimuth, F.col("north_offset_deg")), "sun_elevation": elevation})
    return hours.select(key, "source", "hour_index", "t_ext", "e_dir", "e_dif", "wind_m_s", "sun_azimuth", "sun_elevation"), told
