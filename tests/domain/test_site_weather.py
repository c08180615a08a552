"""Fallbacks, gaps and hour indices of many sites at once."""

from datetime import datetime, timedelta

from calorix.operators import site_weather

SITES = "site_id long, lat double, lon double, north_offset_deg double, utc_offset_s int"
HOURS = "site_id long, source string, seq int, hour_ts timestamp_ntz, t_ext_raw double, e_dir_raw double, e_dif_raw double, wind_raw double"


def hours(site, source, start, n, gaps=(), every=1, years=None):
    out = []
    for i in range(n):
        at = start + timedelta(hours=i)
        if i // 24 in gaps:
            continue
        at = at.replace(year=years[i // 24 % len(years)]) if years else at
        out.append((site, source, i, at, 99.0 if i % every == 0 else None, -1.0, 700.0, -2.0 if i % 2 else None))
    return out


def run(spark, sites, rows):
    told_sites = spark.createDataFrame([(s, 45.0, 3.0, 0.0, off) for s, off in sites], SITES)
    return site_weather.assembled(told_sites, spark.createDataFrame(rows, HOURS))


def test_each_site_takes_what_it_has(spark):
    day = datetime(2024, 1, 1)
    rows = hours(1, "typical", day, 48) + hours(1, "archive", day, 72)
    rows += hours(2, "archive", day, 72, gaps=(1,))
    rows += [(3, "typical", 0, day, None, 1.0, 1.0, 1.0)] + hours(3, "archive", day, 24, every=2)
    rows += hours(4, "typical", day, 8785) + [(6, "typical", 0, None, 1.0, 1.0, 1.0, 1.0)]
    found, told = run(spark, [(1, 0), (2, None), (3, 3600), (4, 0), (5, 0), (6, 0)], rows)
    told = {r["site_id"]: (r["source"], r["n_hours"], r["n_missing"], r["warning"]) for r in told.collect()}
    assert told == {
        1: ("typical", 48, 0, None), 2: ("archive", 48, 0, "typical: no hours"), 3: ("archive", 24, 12, "typical: no complete hour"),
        4: (None, 0, 0, "typical: 8785 hours, more than 8784; archive: no hours"), 5: (None, 0, 0, "typical: no hours; archive: no hours"), 6: (None, 0, 0, "typical: no complete hour; archive: no hours"),
    }
    by_site = {}
    for r in found.collect():
        by_site.setdefault(r["site_id"], {})[r["hour_index"]] = r
    assert sorted(by_site) == [1, 2, 3]
    assert sorted(by_site[2]) == [*range(24), *range(48, 72)], "a missing day counts in an archive"
    assert sorted(by_site[3]) == list(range(1, 25, 2)), "skipped hours leave their places empty, in local time"
    one = by_site[1][0]
    assert (one["t_ext"], one["e_dir"], one["e_dif"], one["wind_m_s"], by_site[1][1]["wind_m_s"]) == (60.0, 0.0, 600.0, None, 0.0)


def test_typical_years_count_changes_of_day(spark):
    rows = hours(1, "typical", datetime(2016, 12, 30), 49, years=(2007, 2011, 2007)) + hours(2, "typical", datetime(2016, 3, 1), 72, gaps=(1,), years=(2009, 2005))
    found, _ = run(spark, [(1, 3600), (2, -7200)], rows)
    index = {}
    for r in found.orderBy("site_id").collect():
        index.setdefault(r["site_id"], []).append(r["hour_index"])
    assert sorted(index[1]) == list(range(1, 50)), "source years don't matter"
    # In local time four days have rows: the last two hours of the first, 22 of the second, two and 22 of those after the gap.
    assert sorted(index[2]) == [22, 23, *range(24, 46), 70, 71, *range(72, 94)]


def test_series_are_dealt_out_once(spark):
    rows = hours(1, "archive", datetime(2024, 1, 1), 30)
    found, _ = run(spark, [(1, 0)], rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(site_id") <= 2 and "RoundRobin" not in plan and "Exchange SinglePartition" not in plan, plan
