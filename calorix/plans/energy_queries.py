"""Queries on calendars, entities, recurrences and whole buildings, with their oracles."""

from __future__ import annotations

import functools
import math

from pyspark.sql import functions as F

from calorix.functions import physics, solar
from calorix.functions.rounding import half_even, half_up, tidy
from calorix.operators import calendars, entities, simulate, weather
from calorix.plans import weather_queries
from calorix.sources.stage import written
from calorix.sources.tables import Warehouse, with_views


def department_members(spark, sf_dir):
    """Departments with the number of their members."""
    w = Warehouse(spark, sf_dir)
    return w.table("region").join(w.table("nation"), F.col("r_regionkey") == F.col("n_regionkey"), "left").groupBy("r_name").agg(F.count("n_nationkey").alias("n_members"))


def stale_cascade(spark, sf_dir):
    """Members of departments whose geometry changed (name after 'AS') become stale; others keep their flag."""
    w = Warehouse(spark, sf_dir)
    changed = w.table("region").where("r_name > 'AS'").select(F.col("r_regionkey").alias("environment_id"))
    members = w.table("nation").select("n_nationkey", F.col("n_regionkey").alias("environment_id"), (F.col("n_nationkey") % 2 == 0).alias("sun_visibility_stale"))
    return entities.stale_after(members, changed).select("n_nationkey", F.col("sun_visibility_stale").alias("stale"))


def holiday_ranges(spark, sf_dir):
    """Runs of holiday days of each zone."""
    out = None
    for zone in ("A", "B", "C"):
        r = calendars.runs(calendars.holiday_days(spark, zone)).select(F.lit(zone).alias("zone"), "first_day", "last_day")
        out = r if out is None else out.union(r)
    return out


def occupancy_setpoints(spark, sf_dir):
    """Hours by setpoints and month of the calendar for the school profile in zone A."""
    days = Warehouse(spark, sf_dir).days()
    cumulative = F.array(*[F.lit(d) for d in calendars.DAYS_BEFORE])
    numbered = days.withColumn("day", F.element_at(cumulative, F.month("d")) + F.dayofmonth("d"))
    ranges = calendars.runs(calendars.holiday_days(spark, "A"))
    off = calendars.in_ranges(numbered, ranges, "day").select("d", F.lit(True).alias("vacation"))
    hours = numbered.join(off, "d", "left").crossJoin(F.broadcast(spark.range(24).withColumnRenamed("id", "hour")))
    shut = calendars.closed("school_ac", F.coalesce("vacation", F.lit(False)), F.weekday("d"))
    low, high = calendars.setpoints("school_ac", shut, F.col("hour"))
    return hours.groupBy(F.month("d").alias("month"), low.alias("t_min"), high.alias("t_max")).agg(F.count(F.lit(1)).alias("hours"))


def slotted(w: Warehouse):
    """Kept hours of the one series with films, sun terms and the 24-slot schedule; a year at most."""
    hours = weather_queries.assembled(w).withColumn("slot", F.pmod("hour_index", F.lit(24))).withColumns(solar.hour_terms(F.col("hour_ts")))
    return weather.with_schedule(hours, w.schedule()).withColumn("g_vent", physics.ventilation_conductance(F.col("debit"), F.col("eta")))


SERIES_FIELDS = ("t_ext", "sun", "g_vent", "gains")


def series_of(w: Warehouse):
    """The hours of the series; ``weather.year`` has checked that they are a year at most."""
    hours = slotted(w).select("hour_index", "t_ext", (F.col("e_dir") * 0.3 + F.col("e_dif") * 0.5).alias("sun"), "g_vent", "gains")
    return simulate.series_arrays(hours, "hour_index", SERIES_FIELDS)


def wall_1d_two_node(spark, sf_dir):
    """Node temperatures of every single outer layer after all hours at 20 degrees inside."""
    w = Warehouse(spark, sf_dir)
    p = {"g": F.col("lam") / F.col("e"), "c": F.col("rho") * F.col("c") * F.col("e") / 2.0 / 3600.0, "h_e": F.lit(25.0), "h_i": F.lit(7.7), "t_int": F.lit(20.0)}
    one = w.layers().where("layer_idx = 0").select("wall_id", *[c.alias(n) for n, c in p.items()])
    end = simulate.advanced(one, "wall_id", series_of(w), tuple(p), simulate.two_node_run, ("t0", "t1"))
    return end.select("wall_id", tidy("t0", 5).alias("t0"), tidy("t1", 5).alias("t1"))


def air_nodes(w: Warehouse, thermostat: bool):
    """End states of one air node per site."""
    p = {"ua": 50.0 + F.col("site_id") % 40, "c": 1200.0 * (200.0 + F.col("site_id") % 90), "t_min": F.lit(19.0), "t_max": F.lit(26.0)}
    nodes, hours = w.sites().select("site_id", *[c.alias(n) for n, c in p.items()]), series_of(w)
    end = simulate.advanced(nodes, "site_id", hours, tuple(p), functools.partial(simulate.air_run, thermostat=thermostat), simulate.AIR_STATE)
    n = F.lit(len(hours["t_ext"]))
    return end.select("site_id", F.struct(p["c"].alias("c")).alias("p"), n.alias("n"), F.struct(*simulate.AIR_STATE).alias("s"))


def air_node_free(spark, sf_dir):
    """Last and mean temperature of free-floating air nodes."""
    return air_nodes(Warehouse(spark, sf_dir), False).select("site_id", tidy("s.t", 5).alias("t_last"), tidy(F.col("s.t_sum") / F.col("n"), 5).alias("t_mean"))


def air_node_thermostat(spark, sf_dir):
    """Heating and cooling of air nodes held between 19 and 26 degrees, in kWh."""
    return air_nodes(Warehouse(spark, sf_dir), True).select("site_id", tidy("s.t", 5).alias("t_last"), tidy(F.col("s.heat") / 3.6e6, 4).alias("heating"), tidy(F.col("s.cool") / 3.6e6, 4).alias("cooling"))


def energy_balance(spark, sf_dir):
    """Energy by channel in kWh and whether the channels close with the stored energy."""
    s = air_nodes(Warehouse(spark, sf_dir), True)
    kwh = lambda c: F.col(f"s.{c}") / 3.6e6
    stored = F.col("p.c") * (F.col("s.t") - 18.0) / 3.6e6
    closes = F.abs(kwh("vent") + kwh("envelope") + kwh("gain") + kwh("heat") - kwh("cool") - stored) < 1e-6
    return s.select("site_id", tidy(kwh("vent"), 4).alias("ventilation"), tidy(kwh("envelope"), 4).alias("envelope"), tidy(kwh("gain"), 4).alias("gains"), tidy(stored, 4).alias("stored"), closes.alias("closes"))


def series_export(spark, sf_dir):
    """Semicolon lines with two decimals per day: hours, mean, least and largest temperature, and a chart path."""
    hours = weather_queries.assembled(Warehouse(spark, sf_dir)).withColumn("day", F.floor(F.col("hour_index") / 24))
    x, y = F.pmod("hour_index", F.lit(24)), half_even(60.0 - F.col("t_ext"), 0).cast("int")
    by_day = hours.groupBy("day").agg(
        F.count(F.lit(1)).alias("n"), F.sum(half_even(F.col("t_ext") * 100).cast("long")).alias("sum"), F.min("t_ext").alias("low"), F.max("t_ext").alias("high"),
        F.array_sort(F.collect_list(F.struct(x.alias("x"), y.alias("y")))).alias("points"),
    )
    cents = lambda c: F.format_string("%.2f", half_up(F.col(c) * 100.0) / 100.0)
    path = F.concat(F.lit("M"), F.array_join(F.transform("points", lambda p: F.concat_ws(" ", p["x"], p["y"])), " L"))
    return by_day.select("day", F.concat_ws(";", "day", "n", "sum", cents("low"), cents("high")).alias("line"), path.alias("path"))


def series_generators(spark, sf_dir):
    """A synthetic week of temperatures, the constant series and the 24-slot day."""
    h = F.col("id")
    wave = 10.0 + 8.0 * F.sin(2 * F.pi() * (h % 24 - 9) / 24.0)
    week = spark.range(168).select(F.lit("wave").alias("series"), h.cast("int").alias("seq"), tidy(wave, 5).alias("value"))
    flat = spark.range(168).select(F.lit("constant").alias("series"), h.cast("int").alias("seq"), F.lit(20.0).alias("value"))
    day = spark.range(24).select(F.lit("schedule").alias("series"), h.cast("int").alias("seq"), F.when((h >= 7) & (h < 19), 90.0).otherwise(15.0).alias("value"))
    return week.union(flat).union(day)


def wall_stacks(w: Warehouse):
    """wall_id and its layers from outside to inside (at most four)."""
    layer = F.struct("e", "lam", "rho", "c", "tau", "r", "alpha")
    return w.layers().groupBy("wall_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("layer_idx", layer.alias("l")))), lambda s: s["l"]).alias("layers"))


#: Surfaces of a sample building: area, normal, inner film, ground, sky share, shading, frame conductance.
FACES = ((40.0, (0.0, -1.0, 0.0), 7.7, False, 0.5, "volet-roulant", 2.0), (30.0, (1.0, 0.0, 0.0), 7.7, False, 0.5, None, 0.0), (50.0, (0.0, 0.0, 1.0), 10.0, False, 1.0, None, 0.0), (50.0, (0.0, 0.0, -1.0), 5.9, True, 0.0, None, 0.0))


def summary(results):
    """The numbers of ``simulate``'s results, rounded."""
    channels = [F.col(f"balance.{c}").alias(c) for c in ("envelope", "solar", "ventilation", "gains", "frames", "stored")]
    flat = results.select("building_id", "t_mean", "heating", "cooling", *channels, F.col("balance.closure").alias("closure"), F.element_at("t_air", -1).alias("t_last"), F.array_max(F.transform("surfaces", lambda s: s["t_inner"])).alias("t_surface_max"))
    return flat.select("building_id", *[tidy(c, 3).alias(c) for c in flat.columns if c not in ("building_id", "closure")], (F.abs("closure") < 1e-6).alias("closes"))


def building_sim(spark, sf_dir):
    """Energy balance of one building per site: four surfaces of walls from the whole wall table, with sun and shutters."""
    w = Warehouse(spark, sf_dir)
    walls = written(wall_stacks(w), "walls")
    n_walls = walls.count()
    face = F.array(*[
        F.struct(F.lit(i).cast("long").alias("class_id"), F.pmod(F.col("site_id") * p, F.lit(n_walls)).alias("wall_id"), F.lit(area).alias("area"), *[F.lit(v).alias(k) for k, v in zip(("nx", "ny", "nz"), normal)],
                 F.lit(h_i).alias("h_i"), F.lit(ground).alias("ground"), F.lit(sky).alias("f_sky"), F.lit(shading).cast("string").alias("shading"), F.lit(g).alias("g_frame"))
        for i, ((area, normal, h_i, ground, sky, shading, g), p) in enumerate(zip(FACES, (7, 11, 13, 17)))
    ])
    surfaces = w.sites().select(F.col("site_id").alias("building_id"), F.inline(face)).join(walls, "wall_id").drop("wall_id")
    buildings = w.sites().select(F.col("site_id").alias("building_id"), "lat", "lon", "north_offset_deg")
    hours = slotted(w).select(F.col("hour_index").alias("seq"), "t_ext", physics.film_coefficient(F.coalesce("wind_m_s", F.lit(0.0))).alias("h_e"), "g_vent", "gains", "e_dir", "e_dif", "declination", "solar_minutes", F.col("shut").alias("closed"))
    return summary(simulate.simulate(surfaces, buildings, hours))


def building_year(spark, sf_dir):
    """One building of 338 triangles over the 8760 hours of a synthetic year with sun, shutters at night and a thermostat."""
    w = Warehouse(spark, sf_dir)
    walls = written(wall_stacks(w), "walls")
    k = F.col("id")
    turn = 2 * math.pi * k / 13.0
    triangles = spark.range(338).select(
        F.lit(1).cast("long").alias("building_id"), k.alias("class_id"), (k % 6).alias("wall_id"), (0.5 + k % 5).cast("double").alias("area"), F.sin(turn).alias("nx"), F.cos(turn).alias("ny"), F.lit(0.0).alias("nz"),
        F.lit(7.7).alias("h_i"), (k % 6 == 5).alias("ground"), F.lit(0.5).alias("f_sky"), F.when(k % 6 == 0, "store-exterieur").alias("shading"), F.lit(0.1).alias("g_frame"),
    )
    ts = (F.timestamp_seconds(F.lit(1_672_531_200) + k * 3600)).cast("timestamp_ntz")
    day = F.greatest(F.lit(0.0), F.sin(2 * math.pi * (k % 24 - 6) / 24.0))
    hours = spark.range(8760).select(
        k.alias("seq"), (10.0 - 8.0 * F.cos(2 * math.pi * k / 8760.0) + 4.0 * day).alias("t_ext"), physics.film_coefficient((k % 9).cast("double")).alias("h_e"), F.lit(30.0).alias("g_vent"), F.lit(200.0).alias("gains"),
        (600.0 * day).alias("e_dir"), (120.0 * day).alias("e_dif"), *[c.alias(n) for n, c in solar.hour_terms(ts).items()], (k % 24 < 6).alias("closed"),
    )
    buildings = spark.range(1).select(F.lit(1).cast("long").alias("building_id"), F.lit(48.0).alias("lat"), F.lit(2.0).alias("lon"))
    return summary(simulate.simulate(triangles.join(walls, "wall_id").drop("wall_id"), buildings, hours))


def wall_layers_run(spark, sf_dir):
    """Last temperatures at the layer borders of every wall of the table, with the air imposed and with it floating."""
    w = Warehouse(spark, sf_dir)
    stacks = written(wall_stacks(w), "walls")
    hours = slotted(w).select(F.col("hour_index").alias("seq"), "t_ext", (F.col("e_dir") * 0.3 + F.col("e_dif") * 0.5).alias("incident"), (F.col("g_vent") / 50.0).alias("g_vent"))
    out = None
    for mode in ("imposed", "free"):
        run = simulate.wall_run(stacks, hours, mode, last=True).select("wall_id", F.lit(mode).alias("mode"), tidy(F.element_at("t_air", -1), 4).alias("t_air"), F.transform(F.element_at("nodes", -1), lambda t: tidy(t, 4)).cast("string").alias("borders"))
        out = run if out is None else out.union(run)
    return out


QUERIES = {f.__name__: f for f in (department_members, stale_cascade, holiday_ranges, occupancy_setpoints, wall_1d_two_node, air_node_free, air_node_thermostat, energy_balance, series_export, series_generators, building_sim, building_year, wall_layers_run)}

RANGES = {z: [x for s, e in calendars.HOLIDAYS["all"] + calendars.HOLIDAYS[z] for a, b in [(calendars.year_day(*s), calendars.year_day(*e))] for x in ([(a, b)] if a <= b else [(a, 365), (1, b)])] for z in "ABC"}
IN_A = " OR ".join(f"day BETWEEN {a} AND {b}" for a, b in RANGES["A"])
DAY = "(CASE month(d) " + " ".join(f"WHEN {m} THEN {b}" for m, b in enumerate(calendars.DAYS_BEFORE, 1)) + " END) + day(d)"
SERIES = f"""{weather_queries.CLAMPED_SQL}, q AS (SELECT CAST(row_number() OVER (ORDER BY hour_index) AS BIGINT) AS n, t_ext, e_dir * 0.3e0 + e_dif * 0.5e0 AS sun,
  0.34e0 * debit * (1e0 - eta) AS g_vent, gains FROM w LEFT JOIN v8 ON v8.slot = ((w.hour_index % 24) + 24) % 24)"""


def air_sql(thermostat: bool) -> str:
    free = "(c/3600e0*t + (ua+q.g_vent)*q.t_ext + q.gains) / (c/3600e0 + ua + q.g_vent)"
    new = f"CASE WHEN {free} < 19e0 THEN 19e0 WHEN {free} > 26e0 THEN 26e0 ELSE {free} END" if thermostat else free
    hvac = f"((c/3600e0 + ua + q.g_vent) * ({new}) - (c/3600e0*t + (ua+q.g_vent)*q.t_ext + q.gains))" if thermostat else "0e0"
    return f"""{SERIES}, a AS (
      SELECT site_id, 50e0 + site_id % 40 AS ua, 1200e0 * (200e0 + site_id % 90) AS c, CAST(0 AS BIGINT) AS n, 18e0 AS t, 0e0 AS t_sum, 0e0 AS heat, 0e0 AS cool, 0e0 AS vent, 0e0 AS envelope, 0e0 AS gain FROM v2
      UNION ALL SELECT site_id, ua, c, q.n, {new}, t_sum + ({new}), heat + greatest({hvac}, 0e0) * 3600e0, cool + greatest(-({hvac}), 0e0) * 3600e0,
        vent + q.g_vent * (q.t_ext - ({new})) * 3600e0, envelope + ua * (q.t_ext - ({new})) * 3600e0, gain + q.gains * 3600e0 FROM a JOIN q ON q.n = a.n + 1),
    z AS (SELECT * FROM a WHERE n = (SELECT max(n) FROM q))"""


ORACLES = {
    "department_members": "SELECT r_name, count(n_nationkey) AS n_members FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name",
    "stale_cascade": "SELECT n_nationkey, n_nationkey % 2 = 0 OR n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name > 'AS') AS stale FROM nation",
    "holiday_ranges": " UNION ALL ".join(
        f"""SELECT '{z}' AS zone, CAST(min(d) AS INT) AS first_day, CAST(max(d) AS INT) AS last_day FROM (SELECT d, d - row_number() OVER (ORDER BY d) AS g FROM range(1, 366) t(d)
        WHERE {' OR '.join(f'd BETWEEN {a} AND {b}' for a, b in r)}) GROUP BY g""" for z, r in RANGES.items()),
    "occupancy_setpoints": with_views(
        f"""WITH n AS (SELECT d, {DAY} AS day FROM v7), c AS (SELECT d, ({IN_A}) OR isodow(d) >= 6 AS shut FROM n),
        h AS (SELECT d, shut, i AS hour, i >= 7 AND i < 19 AS light FROM c CROSS JOIN range(24) t(i))
        SELECT CAST(month(d) AS INT) AS month, CASE WHEN shut THEN 7e0 WHEN light THEN 19e0 ELSE 16e0 END AS t_min, CASE WHEN NOT shut AND light THEN 26e0 ELSE 100e0 END AS t_max, count(*) AS hours FROM h GROUP BY 1, 2, 3""", "v7"),
    "wall_1d_two_node": with_views(
        f"""WITH {SERIES}, p AS (SELECT wall_id, lam/e AS g, rho*c*e/2e0/3600e0 AS c FROM v3 WHERE layer_idx = 0),
        s AS (SELECT wall_id, g, c, CAST(0 AS BIGINT) AS n, 15e0 AS t0, 15e0 AS t1 FROM p
          UNION ALL SELECT wall_id, g, c, q.n, ((c*t0 + 25e0*q.t_ext + q.sun)*(c+g+7.7e0) + g*(c*t1 + 7.7e0*20e0)) / ((c+g+25e0)*(c+g+7.7e0) - g*g),
            ((c+g+25e0)*(c*t1 + 7.7e0*20e0) + g*(c*t0 + 25e0*q.t_ext + q.sun)) / ((c+g+25e0)*(c+g+7.7e0) - g*g) FROM s JOIN q ON q.n = s.n + 1)
        SELECT wall_id, round(t0, 5) + 0e0 AS t0, round(t1, 5) + 0e0 AS t1 FROM s WHERE n = (SELECT max(n) FROM q)""", "v1", "v3", "v8", recursive=True),
    "air_node_free": with_views(f"WITH {air_sql(False)} SELECT site_id, round(t, 5) + 0e0 AS t_last, round(t_sum / n, 5) + 0e0 AS t_mean FROM z", "v1", "v2", "v8", recursive=True),
    "air_node_thermostat": with_views(f"WITH {air_sql(True)} SELECT site_id, round(t, 5) + 0e0 AS t_last, round(heat / 3.6e6, 4) + 0e0 AS heating, round(cool / 3.6e6, 4) + 0e0 AS cooling FROM z", "v1", "v2", "v8", recursive=True),
    "energy_balance": with_views(
        f"""WITH {air_sql(True)} SELECT site_id, round(vent / 3.6e6, 4) + 0e0 AS ventilation, round(envelope / 3.6e6, 4) + 0e0 AS envelope, round(gain / 3.6e6, 4) + 0e0 AS gains,
        round(c * (t - 18e0) / 3.6e6, 4) + 0e0 AS stored, true AS closes FROM z""", "v1", "v2", "v8", recursive=True),
    "series_export": with_views(
        f"""WITH {weather_queries.CLAMPED_SQL}, d AS (SELECT *, CAST(floor(hour_index / 24e0) AS BIGINT) AS day FROM w)
        SELECT day, concat_ws(';', day, count(*), CAST(sum(CAST(round_even(t_ext * 100, 0) AS BIGINT)) AS BIGINT), printf('%.2f', floor(min(t_ext)*100e0+0.5e0)/100e0), printf('%.2f', floor(max(t_ext)*100e0+0.5e0)/100e0)) AS line,
        'M' || string_agg((hour_index % 24) || ' ' || CAST(round_even(60e0 - t_ext, 0) AS INT), ' L' ORDER BY hour_index) AS path FROM d GROUP BY day""", "v1"),
    "series_generators": """SELECT 'wave' AS series, CAST(i AS INT) AS seq, round(10e0 + 8e0 * sin(2e0 * pi() * (i % 24 - 9) / 24e0), 5) + 0e0 AS value FROM range(168) t(i)
        UNION ALL SELECT 'constant', CAST(i AS INT), 20e0 FROM range(168) t(i) UNION ALL SELECT 'schedule', CAST(i AS INT), CASE WHEN i >= 7 AND i < 19 THEN 90e0 ELSE 15e0 END FROM range(24) t(i)""",
}


def hour_calendar(spark, sf_dir):
    """Kept hours by weekday and hour of day, with their mean temperature."""
    from calorix.functions import display

    _, weekday, hour = display.hour_parts(F.col("hour_index"), F.lit(0))
    hours = weather_queries.assembled(Warehouse(spark, sf_dir))
    # Sums of whole micro-degrees don't depend on the order of the rows.
    micro = F.sum(half_up(F.col("t_ext") * 1e6).cast("long"))
    return hours.groupBy(weekday.cast("int").alias("weekday"), hour.cast("int").alias("hour")).agg(F.count(F.lit(1)).alias("n"), tidy(micro / (F.count(F.lit(1)) * 1e6), 4).alias("t_mean"))


def closed_schedules(spark, sf_dir):
    """The 24 slots of closed days with their ventilation conductance."""
    from calorix.functions import display

    slots = display.closed_schedule(Warehouse(spark, sf_dir).schedule())
    return slots.select("slot", tidy("debit").alias("debit"), tidy("gains").alias("gains"), "shut", tidy(physics.ventilation_conductance(F.col("debit"), F.col("eta"))).alias("g_vent"))


QUERIES |= {f.__name__: f for f in (hour_calendar, closed_schedules)}
ORACLES |= {
    "hour_calendar": with_views(
        f"WITH {weather_queries.CLAMPED_SQL} SELECT CAST(CAST(floor(hour_index / 24e0) AS BIGINT) % 7 AS INT) AS weekday, CAST(hour_index % 24 AS INT) AS hour, count(*) AS n, round(CAST(sum(CAST(floor(t_ext * 1e6 + 0.5e0) AS BIGINT)) AS DOUBLE) / (count(*) * 1e6), 4) + 0e0 AS t_mean FROM w GROUP BY 1, 2", "v1"),
    "closed_schedules": with_views("SELECT slot, round(debit * 0.15e0, 6) + 0e0 AS debit, 0e0 AS gains, shut, round(0.34e0 * (debit * 0.15e0) * (1e0 - eta), 6) + 0e0 AS g_vent FROM v8", "v8"),
}
