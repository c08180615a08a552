"""Queries on weather, sun and places, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from calorix.functions import geodesy, physics, solar
from calorix.functions.rounding import tidy
from calorix.operators import places, weather
from calorix.sources.tables import Warehouse, with_views

OFFSET_S = 3600
CLAMPED_SQL = """k AS (SELECT * FROM v1 WHERE t_ext_raw IS NOT NULL AND e_dir_raw IS NOT NULL AND e_dif_raw IS NOT NULL),
w AS (SELECT hour_ts, greatest(-60e0, least(60e0, t_ext_raw)) AS t_ext, greatest(0e0, least(1400e0, e_dir_raw)) AS e_dir,
  greatest(0e0, least(600e0, e_dif_raw)) AS e_dif, CASE WHEN wind_raw IS NOT NULL THEN greatest(wind_raw, 0e0) END AS wind_m_s,
  CAST(date_diff('day', CAST(min(CAST(hour_ts + INTERVAL 3600 SECOND AS DATE)) OVER () AS DATE), CAST(hour_ts + INTERVAL 3600 SECOND AS DATE)) * 24
    + hour(hour_ts + INTERVAL 3600 SECOND) AS INT) AS hour_index FROM k)"""
SUN_SQL = """g AS (SELECT *, 2e0 * pi() * (dayofyear(hour_ts) - 1) / 365e0 AS g FROM w CROSS JOIN s),
d AS (SELECT *, radians(degrees(0.006918e0 - 0.399912e0*cos(g) + 0.070257e0*sin(g) - 0.006758e0*cos(2*g) + 0.000907e0*sin(2*g) - 0.002697e0*cos(3*g) + 0.00148e0*sin(3*g))) AS dec,
  229.18e0*(0.000075e0 + 0.001868e0*cos(g) - 0.032077e0*sin(g) - 0.014615e0*cos(2*g) - 0.040849e0*sin(2*g)) AS eot, radians(lat) AS phi FROM g),
h AS (SELECT *, radians((hour(hour_ts)*60e0 + minute(hour_ts) + second(hour_ts)/60e0 + eot + lon*4e0)/4e0 - 180e0) AS h FROM d),
p AS (SELECT *, degrees(asin(greatest(-1e0, least(1e0, sin(phi)*sin(dec) + cos(phi)*cos(dec)*cos(h))))) AS elevation,
  degrees(atan2(-cos(dec)*sin(h), sin(dec)*cos(phi) - cos(dec)*sin(phi)*cos(h))) AS az FROM h),
z AS (SELECT *, CASE WHEN az < 0 THEN az + 360e0 ELSE az END AS azimuth FROM p)"""


def assembled(w: Warehouse):
    """A series' kept and clamped hours: a year at most, so they may be broadcast."""
    return weather.local_hour_index(weather.clamped(weather.kept_hours(weather.year(w.weather_raw()))), OFFSET_S)


def weather_assemble(spark, sf_dir):
    """Kept, clamped hours with their local hour index."""
    return assembled(Warehouse(spark, sf_dir)).select("hour_index", *[tidy(c).alias(c) for c in ("t_ext", "e_dir", "e_dif", "wind_m_s")])


def weather_missing_count(spark, sf_dir):
    """Hours read, skipped, and kept without wind."""
    return weather.missing_counts(Warehouse(spark, sf_dir).weather_raw())


def tmy_hour_index(spark, sf_dir):
    """Typical-year index over kept hours."""
    hours = weather.kept_hours(weather.year(Warehouse(spark, sf_dir).weather_raw())).withColumn("hour_ts", F.col("hour_ts").cast("timestamp"))
    return weather.change_hour_index(hours, "hour_ts").select("hour_index", tidy("t_ext_raw").alias("t_ext"))


def sun(w: Warehouse):
    """Kept hours at every site with the sun's position."""
    return solar.positions(assembled(w), w.sites())


def solar_position(spark, sf_dir):
    """Azimuth and elevation of every kept hour and site."""
    return sun(Warehouse(spark, sf_dir)).select("site_id", "hour_index", tidy("azimuth", 5).alias("azimuth"), tidy("elevation", 5).alias("elevation"))


def local_azimuth(spark, sf_dir):
    """Azimuth in each site's own frame."""
    turned = solar.local_azimuth(F.col("azimuth"), F.col("north_offset_deg"))
    return sun(Warehouse(spark, sf_dir)).where("elevation > 0").select("site_id", "hour_index", tidy(turned, 5).alias("local_azimuth"))


def weather_solar_hours(spark, sf_dir):
    """Clean hours at every site with local sun position and film coefficient."""
    return sun(Warehouse(spark, sf_dir)).select(
        "site_id",
        "hour_index",
        *[tidy(c).alias(c) for c in ("t_ext", "e_dir", "e_dif", "wind_m_s")],
        tidy(solar.local_azimuth(F.col("azimuth"), F.col("north_offset_deg")), 5).alias("sun_azimuth"),
        tidy("elevation", 5).alias("sun_elevation"),
        tidy(physics.film_coefficient(F.col("wind_m_s"))).alias("h_e"),
    )


def h_e_from_wind(spark, sf_dir):
    """Film coefficient of each kept hour with wind."""
    hours = weather.clamped(weather.kept_hours(Warehouse(spark, sf_dir).weather_raw())).where("wind_m_s is not null")
    return hours.groupBy(tidy(physics.film_coefficient(F.col("wind_m_s"))).alias("h_e")).agg(F.count(F.lit(1)).alias("n_hours"))


def boundary_combos(spark, sf_dir):
    """Distinct (ventilation, film, shutter) combinations over the hours' slots."""
    w = Warehouse(spark, sf_dir)
    hours = assembled(w).withColumn("slot", weather.slot_of(F.col("hour_index"), F.lit(0), F.col("hour_index")))
    joined = weather.with_schedule(hours, w.schedule())
    wind = F.coalesce("wind_m_s", F.lit(0.0))
    return joined.select(
        tidy(physics.ventilation_conductance(F.col("debit"), F.col("eta"))).alias("g_vent"), tidy(physics.film_coefficient(wind)).alias("h_e"), F.col("shut").alias("closed")
    ).distinct()


def geo_project(spark, sf_dir):
    """Candidates in the frame of the origin (10, 20), turned by 30 degrees."""
    x, y = geodesy.project(F.col("lat"), F.col("lon"), F.lit(10.0), F.lit(20.0))
    u, v = geodesy.rotate(x, y, F.lit(30.0))
    return Warehouse(spark, sf_dir).candidates().select("cand_id", tidy(u, 3).alias("x"), tidy(v, 3).alias("y"))


def geo_roundtrip(spark, sf_dir):
    """Projection and back, with the rotation undone."""
    x, y = geodesy.project(F.col("lat"), F.col("lon"), F.lit(10.0), F.lit(20.0))
    u, v = geodesy.rotate(*geodesy.rotate(x, y, F.lit(37.0)), F.lit(-37.0))
    lat, lon = geodesy.unproject(u, v, F.lit(10.0), F.lit(20.0))
    return Warehouse(spark, sf_dir).candidates().select("cand_id", tidy(lat).alias("lat"), tidy(lon).alias("lon"))


def country_filter(spark, sf_dir):
    """Candidates, drawn together around the country, inside its boxes."""
    near = Warehouse(spark, sf_dir).candidates().withColumns({"lat": F.col("lat") / 10.0 + 46.0, "lon": F.col("lon") / 20.0 + 2.0})
    return near.where(geodesy.in_country(F.col("lat"), F.col("lon"))).select("cand_id", tidy("lat").alias("lat"), tidy("lon").alias("lon"))


def bbox_search_topk(spark, sf_dir):
    """Per site the five nearest buildings of at most 30 walls in its box, and how many nearer ones were too complex."""
    w = Warehouse(spark, sf_dir)
    found = places.nearest_in_boxes(w.sites().select("site_id", "lat", "lon"), w.candidates(), 110_000.0, F.col("n_walls") <= 30, 5, "cand_id")
    return found.select("site_id", "cand_id", F.col("rank").cast("long").alias("rank"), F.col("skipped").cast("long").alias("skipped"), tidy("dist", 3).alias("dist"))


def prefix_cap(spark, sf_dir):
    """Per source the nearest buildings until 20 000 vertices or triangles, with their offsets."""
    w = Warehouse(spark, sf_dir)
    x, y = geodesy.project(F.col("lat"), F.col("lon"), F.lit(0.0), F.lit(0.0))
    items = w.candidates().select("source", "cand_id", F.hypot(x, y).alias("dist"), (F.col("n_walls") * 2).alias("n_vertices"), (F.col("n_walls") * 4 - 4).alias("n_triangles"))
    kept = places.admitted(items, ("n_vertices", "n_triangles"), (20_000, 20_000), ("dist", "cand_id"), ("source",))
    return kept.select("source", "cand_id", "n_vertices_offset", "n_triangles_offset")


def source_fallback(spark, sf_dir):
    """Per one-degree cell the primary source's candidates, or the secondary's where it has none."""
    cells = Warehouse(spark, sf_dir).candidates().withColumn("cell", F.floor(F.col("lat")) * 1000 + F.floor(F.col("lon")))
    return weather.first_available(cells.where("source = 'ign'"), cells.where("source = 'osm'"), "cell").select("cell", "cand_id", "source")


def base_altitude(spark, sf_dir):
    """Candidates' altitude over a reference; every third has its own, the rest is looked up in a partial table."""
    w = Warehouse(spark, sf_dir)
    items = w.candidates().select("cand_id", F.when(F.col("cand_id") % 3 == 0, F.col("n_walls") + 100.0).alias("base_z"))
    lookup = w.sites().select((F.col("site_id") * 2).alias("cand_id"), (F.col("lat") + 90.0).alias("altitude"))
    return places.base_altitudes(items, lookup, 106.9, "cand_id").select("cand_id", tidy("base_rel").alias("base_rel"))


XY0 = "radians(lon - 20e0) * 6378137e0 * cos(radians(10e0)) AS x, radians(lat - 10e0) * 6378137e0 AS y"
BOX_SQL = " OR ".join(f"(lat BETWEEN {s} AND {n} AND lon BETWEEN {w} AND {e})" for s, n, w, e in geodesy.COUNTRY_BOXES)
R6 = lambda *cols: ", ".join(f"round({c}, 6) + 0e0 AS {c}" for c in cols)

QUERIES = {f.__name__: f for f in (weather_solar_hours, weather_assemble, weather_missing_count, tmy_hour_index, solar_position, local_azimuth, h_e_from_wind, boundary_combos, geo_project, geo_roundtrip, country_filter, bbox_search_topk, prefix_cap, source_fallback, base_altitude)}
ORACLES = {
    "weather_solar_hours": with_views(
        f"""WITH {CLAMPED_SQL}, s AS (SELECT * FROM v2), {SUN_SQL},
        l AS (SELECT *, radians(azimuth) AS a, radians(north_offset_deg) AS t FROM z),
        m AS (SELECT *, degrees(atan2(sin(a)*cos(t) - cos(a)*sin(t), sin(a)*sin(t) + cos(a)*cos(t))) AS q FROM l)
        SELECT site_id, hour_index, {R6('t_ext', 'e_dir', 'e_dif', 'wind_m_s')}, round(CASE WHEN q < 0 THEN q + 360e0 ELSE q END, 5) + 0e0 AS sun_azimuth,
        round(elevation, 5) + 0e0 AS sun_elevation, round(5.8e0 + 3.94e0 * greatest(round_even(wind_m_s, 0), 0e0), 6) * (CASE WHEN wind_m_s IS NULL THEN NULL ELSE 1e0 END) + 0e0 AS h_e FROM m""", "v1", "v2"),
    "weather_assemble": with_views(f"WITH {CLAMPED_SQL} SELECT hour_index, {R6('t_ext', 'e_dir', 'e_dif', 'wind_m_s')} FROM w", "v1"),
    "weather_missing_count": with_views(
        """SELECT count(*) AS n_hours, count(*) FILTER (WHERE t_ext_raw IS NULL OR e_dir_raw IS NULL OR e_dif_raw IS NULL) AS n_missing,
        count(*) FILTER (WHERE t_ext_raw IS NOT NULL AND e_dir_raw IS NOT NULL AND e_dif_raw IS NOT NULL AND wind_raw IS NULL) AS n_no_wind FROM v1""", "v1"),
    "tmy_hour_index": with_views(
        """WITH k AS (SELECT hour_ts, t_ext_raw, strftime(hour_ts, '%m%d') AS md FROM v1 WHERE t_ext_raw IS NOT NULL AND e_dir_raw IS NOT NULL AND e_dif_raw IS NOT NULL),
        c AS (SELECT *, CASE WHEN lag(md) OVER (ORDER BY hour_ts) IS NULL OR lag(md) OVER (ORDER BY hour_ts) <> md THEN 1 ELSE 0 END AS ch FROM k)
        SELECT CAST((sum(ch) OVER (ORDER BY hour_ts) - 1) * 24 + hour(hour_ts) AS INT) AS hour_index, round(t_ext_raw, 6) + 0e0 AS t_ext FROM c""", "v1"),
    "solar_position": with_views(f"WITH {CLAMPED_SQL}, s AS (SELECT * FROM v2), {SUN_SQL} SELECT site_id, hour_index, round(azimuth, 5) + 0e0 AS azimuth, round(elevation, 5) + 0e0 AS elevation FROM z", "v1", "v2"),
    "local_azimuth": with_views(
        f"""WITH {CLAMPED_SQL}, s AS (SELECT * FROM v2), {SUN_SQL},
        l AS (SELECT *, radians(azimuth) AS a, radians(north_offset_deg) AS t FROM z WHERE elevation > 0),
        m AS (SELECT *, degrees(atan2(sin(a)*cos(t) - cos(a)*sin(t), sin(a)*sin(t) + cos(a)*cos(t))) AS q FROM l)
        SELECT site_id, hour_index, round(CASE WHEN q < 0 THEN q + 360e0 ELSE q END, 5) + 0e0 AS local_azimuth FROM m""", "v1", "v2"),
    "h_e_from_wind": with_views(f"WITH {CLAMPED_SQL} SELECT round(5.8e0 + 3.94e0 * greatest(round_even(wind_m_s, 0), 0e0), 6) + 0e0 AS h_e, count(*) AS n_hours FROM w WHERE wind_m_s IS NOT NULL GROUP BY 1", "v1"),
    "boundary_combos": with_views(
        f"""WITH {CLAMPED_SQL} SELECT DISTINCT round(0.34e0 * debit * (1e0 - eta), 6) + 0e0 AS g_vent,
        round(5.8e0 + 3.94e0 * greatest(round_even(coalesce(wind_m_s, 0e0), 0), 0e0), 6) + 0e0 AS h_e, shut AS closed
        FROM w LEFT JOIN v8 ON v8.slot = ((w.hour_index % 24) + 24) % 24""", "v1", "v8"),
    "geo_project": with_views(
        f"""WITH p AS (SELECT cand_id, {XY0} FROM v5) SELECT cand_id, round(x * cos(radians(30e0)) - y * sin(radians(30e0)), 3) + 0e0 AS x,
        round(x * sin(radians(30e0)) + y * cos(radians(30e0)), 3) + 0e0 AS y FROM p""", "v5"),
    "geo_roundtrip": with_views("SELECT cand_id, round(lat, 6) + 0e0 AS lat, round(lon, 6) + 0e0 AS lon FROM v5", "v5"),
    "country_filter": with_views(f"WITH q AS (SELECT cand_id, lat / 10e0 + 46e0 AS lat, lon / 20e0 + 2e0 AS lon FROM v5) SELECT cand_id, {R6('lat', 'lon')} FROM q WHERE {BOX_SQL}", "v5"),
    "bbox_search_topk": with_views(
        """WITH p AS (SELECT site_id, cand_id, n_walls, sqrt(power(radians(c.lon - s.lon) * 6378137e0 * cos(radians(s.lat)), 2) + power(radians(c.lat - s.lat) * 6378137e0, 2)) AS dist
          FROM v2 s JOIN v5 c ON abs(c.lat - s.lat) <= degrees(110000e0 / 6378137e0) AND abs(c.lon - s.lon) <= degrees(110000e0 / (6378137e0 * cos(radians(s.lat))))),
        r AS (SELECT *, sum(CASE WHEN n_walls <= 30 THEN 1 ELSE 0 END) OVER (PARTITION BY site_id ORDER BY dist, cand_id) AS upto FROM p),
        q AS (SELECT *, sum(CASE WHEN n_walls > 30 AND upto < 5 THEN 1 ELSE 0 END) OVER (PARTITION BY site_id) AS skipped FROM r)
        SELECT site_id, cand_id, CAST(upto AS BIGINT) AS rank, CAST(skipped AS BIGINT) AS skipped, round(dist, 3) + 0e0 AS dist FROM q WHERE n_walls <= 30 AND upto <= 5""", "v2", "v5"),
    "prefix_cap": with_views(
        """WITH i AS (SELECT source, cand_id, n_walls * 2 AS nv, n_walls * 4 - 4 AS nt, sqrt(power(radians(lon) * 6378137e0, 2) + power(radians(lat) * 6378137e0, 2)) AS dist FROM v5),
        t AS (SELECT *, sum(nv) OVER (PARTITION BY source ORDER BY dist, cand_id) AS sv, sum(nt) OVER (PARTITION BY source ORDER BY dist, cand_id) AS st FROM i)
        SELECT source, cand_id, CAST(sv - nv AS BIGINT) AS n_vertices_offset, CAST(st - nt AS BIGINT) AS n_triangles_offset FROM t WHERE sv <= 20000 AND st <= 20000""", "v5"),
    "source_fallback": with_views(
        """WITH c AS (SELECT CAST(floor(lat) AS BIGINT) * 1000 + CAST(floor(lon) AS BIGINT) AS cell, cand_id, source FROM v5)
        SELECT cell, cand_id, source FROM c WHERE source = 'ign' OR cell NOT IN (SELECT cell FROM c WHERE source = 'ign')""", "v5"),
    "base_altitude": with_views(
        """SELECT c.cand_id, round(CASE WHEN c.cand_id % 3 = 0 THEN c.n_walls + 100e0 - 106.9e0 WHEN s.site_id IS NOT NULL THEN s.lat + 90e0 - 106.9e0 ELSE 0e0 END, 6) + 0e0 AS base_rel
        FROM v5 c LEFT JOIN v2 s ON s.site_id * 2 = c.cand_id""", "v2", "v5"),
}
