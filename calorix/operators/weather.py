"""Hourly weather: skipping, clamping, local hours, typical years, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calorix.functions.rounding import clamp
from calorix.sources.stage import written

REQUIRED = ("t_ext_raw", "e_dir_raw", "e_dif_raw")
MAX_HOURS = 8784


def kept_hours(raw: DataFrame) -> DataFrame:
    """Hours whose temperature and radiation are all there; a missing wind keeps the hour."""
    return raw.dropna(subset=list(REQUIRED))


def clamped(hours: DataFrame) -> DataFrame:
    """Channels within physical bounds; a missing wind stays missing."""
    return hours.withColumns({
        "t_ext": clamp(F.col("t_ext_raw"), -60.0, 60.0),
        "e_dir": clamp(F.col("e_dir_raw"), 0.0, 1400.0),
        "e_dif": clamp(F.col("e_dif_raw"), 0.0, 600.0),
        "wind_m_s": F.when(F.col("wind_raw").isNotNull(), F.greatest(F.col("wind_raw"), F.lit(0.0))),
    })


def year(raw: DataFrame) -> DataFrame:
    """One series' rows, written and read back, so that later steps may broadcast them: none kept, or more than MAX_HOURS, is an error."""
    hours = written(raw, "hours")
    n = kept_hours(hours).count()
    if not 0 < n <= MAX_HOURS:
        raise ValueError(f"{n} usable hours: there must be some, and no more than {MAX_HOURS}")
    return hours


def beside(rows: DataFrame, few: DataFrame, series: tuple[str, ...]) -> DataFrame:
    """Rows with the values of their series; without series ``few`` is one row and is broadcast."""
    return rows.join(few, list(series)) if series else rows.crossJoin(F.broadcast(few))


def local_hour_index(hours: DataFrame, offset_s: int | Column, series: tuple[str, ...] = ()) -> DataFrame:
    """Hours since local midnight of the first kept row; whole missing days still count.

    The offset is a number of seconds or a column of them (a null one counts as none).
    """
    offset = F.coalesce(offset_s, F.lit(0)) if isinstance(offset_s, Column) else F.lit(offset_s)
    local = hours.withColumn("__local", F.col("hour_ts") + F.make_dt_interval(secs=offset))
    first = local.groupBy(*series).agg(F.min(F.to_date("__local")).alias("__first"))
    index = F.datediff(F.to_date("__local"), F.col("__first")) * 24 + F.hour("__local")
    return beside(local, first, series).withColumn("hour_index", index.cast("int")).drop("__local", "__first")


def change_hour_index(hours: DataFrame, order: str, series: tuple[str, ...] = ()) -> DataFrame:
    """Typical-year index: days count by changes of (month, day) among kept rows, so a whole missing day doesn't count.

    Days are numbered on one row each, never on hours.
    """
    dated = hours.withColumn("__date", F.to_date(order))
    days = dated.select(*series, "__date").distinct()
    w = Window.partitionBy(*series).orderBy("__date")
    month_day = F.date_format("__date", "MMdd")
    changed = F.when(F.lag(month_day).over(w).isNull() | (F.lag(month_day).over(w) != month_day), 1).otherwise(0)
    numbered = days.withColumn("__changed", changed).withColumn("__day", F.sum("__changed").over(w) - 1).drop("__changed")
    return dated.join(numbered, [*series, "__date"]).withColumn("hour_index", (F.col("__day") * 24 + F.hour(order)).cast("int")).drop("__date", "__day")


def with_offsets(rows: DataFrame, probes: DataFrame, key: str) -> DataFrame:
    """Rows with ``utc_offset_s`` of their place; null where the probe has none."""
    return rows.join(probes.select(key, F.col("utc_offset_seconds").cast("int").alias("utc_offset_s")), key, "left")


def zipped(left: DataFrame, right: DataFrame, seq: str = "seq", strict: bool = False) -> DataFrame:
    """Rows of both by position, the right one's values over the left's of the same name.

    If the numbers of rows differ, the left stays as it is, or with ``strict`` it is an error.
    """
    n, m = left.count(), right.count()
    if n != m:
        if strict:
            raise ValueError(f"{n} rows against {m}")
        return left
    return merged(left, right, [seq])


def merged(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left joined with right by keys; of fields that both have the right one's value wins where it isn't null."""
    both = [c for c in right.columns if c in left.columns and c not in keys]
    joined = left.join(right.withColumnsRenamed({c: f"__{c}" for c in both}), keys, "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", c) for c in both}).drop(*[f"__{c}" for c in both])


def missing_counts(raw: DataFrame) -> DataFrame:
    """Rows, skipped rows and kept rows without wind in one pass."""
    gone = F.lit(False)
    for c in REQUIRED:
        gone = gone | F.col(c).isNull()
    return raw.agg(F.count(F.lit(1)).alias("n_hours"), F.count_if(gone).alias("n_missing"), F.count_if(~gone & F.col("wind_raw").isNull()).alias("n_no_wind"))


def checked(raw: DataFrame) -> DataFrame:
    """The input, or an error when nothing is kept or there are too many hours."""
    n = kept_hours(raw).agg(F.count(F.lit(1)).alias("__n"))
    ok = F.assert_true((F.col("__n") > 0) & (F.col("__n") <= MAX_HOURS), F.lit("no usable hour, or more hours than a leap year"))
    return raw.crossJoin(F.broadcast(n)).where(ok.isNull()).drop("__n")  # n is one row


def first_available(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """Per key the primary's rows, or the secondary's where the primary has none."""
    return primary.unionByName(secondary.join(primary.select(key).distinct(), key, "left_anti"))


def slot_of(hour_index: Column, start: Column, seq: Column) -> Column:
    """Schedule slot of an hour, 0 to 23."""
    return F.pmod(F.coalesce(hour_index, start + seq), F.lit(24)).cast("int")


def with_schedule(hours: DataFrame, opened: DataFrame | None, closed: DataFrame | None = None) -> DataFrame:
    """Hours with their slot's values; hours whose ``occupied`` is literally false take the closed schedule where there is one.

    A closed schedule without an open one is an error; with none, hours stay as they are.
    """
    if opened is None:
        if closed is not None:
            raise ValueError("a closed schedule needs an open one")
        return hours
    fields = [c for c in opened.columns if c != "slot"]
    joined = hours.join(opened, "slot", "left")
    if closed is None:
        return joined
    other = closed.select("slot", *[F.col(c).alias(f"__{c}") for c in fields], F.lit(True).alias("__closed"))
    joined = joined.join(other, "slot", "left")
    use = F.col("occupied").eqNullSafe(F.lit(False)) & F.coalesce("__closed", F.lit(False))
    return joined.withColumns({c: F.when(use, F.col(f"__{c}")).otherwise(F.col(c)) for c in fields}).drop("__closed", *[f"__{c}" for c in fields])
