"""Queries on polygons, surroundings, sources by position and presentation, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from calorix.functions import display, physics
from calorix.functions.rounding import half_up, tidy
from calorix.operators import entities, meshes, places, polygons, visibility, weather
from calorix.plans import weather_queries
from calorix.sources import readers
from calorix.sources.tables import Warehouse, with_views

#: An L of two boxes around a square hole, and a long strip: study polygons with whole coordinates.
ELL = [[(100.0, 0.0), (160.0, 0.0), (160.0, 40.0), (130.0, 40.0), (130.0, 90.0), (100.0, 90.0)], [(110.0, 10.0), (120.0, 10.0), (120.0, 20.0), (110.0, 20.0)]]
STRIP = [[(100.0, -10.0), (100.0, 4000.0), (131.0, 4000.0), (131.0, -10.0)]]


def boxes(w: Warehouse):
    """Candidates as boxes of whole metres on a lattice of 15 m."""
    k = F.col("cand_id")
    x, y, a, b = (k % 40) * 15, F.floor(k / 40) * 15, 4 + k % 17, 4 + k % 11
    corner = lambda u, v: F.struct(u.cast("double").alias("x"), v.cast("double").alias("y"))
    # Every third ring turns the other way.
    ring = F.array(corner(x, y), corner(x + a, y), corner(x + a, y + b), corner(x, y + b))
    return w.candidates().select(k.alias("item"), F.when(k % 3 == 0, F.reverse(ring)).otherwise(ring).alias("ring"), (F.col("n_walls") / 4.0).alias("height"), "source", F.hypot(x, y).alias("dist"))


def study_overlap(spark, sf_dir):
    """Status of boxes against a concave study polygon with a hole, with overlap and what is left."""
    found = polygons.resolved(boxes(Warehouse(spark, sf_dir)), ELL)
    return found.select("item", "status", tidy("area", 4).alias("area"), tidy("overlap", 4).alias("overlap"), tidy(F.when(F.col("status") == "self", 0.0).otherwise(F.col("area") - F.col("overlap")), 4).alias("left_area"))


def obstacle_admission(spark, sf_dir):
    """Boxes around a strip: those that stay, extruded, by distance until 20 000 vertices, with the offsets of their meshes."""
    found = polygons.resolved(boxes(Warehouse(spark, sf_dir)), STRIP).where("status in ('kept', 'clipped')").withColumn("base", F.lit(0.0))
    sized = found.withColumn("n_vertices", polygons.corner_count(F.col("parts")))
    # Every box has vertices, so no more boxes than vertices come in; only those that the vertices let in are extruded.
    near = places.admitted(places.nearest(sized, 20_000, ("dist", "item")), ("n_vertices",), (20_000,), ("dist", "item"))
    solid = polygons.extruded_parts(near.drop("n_vertices_offset")).select("item", "dist", "n_vertices", F.size("faces").alias("n_triangles"))
    return places.admitted(solid, ("n_vertices", "n_triangles"), (20_000, 20_000), ("dist", "item")).select("item", "n_vertices", "n_triangles", "n_vertices_offset", "n_triangles_offset")


def nearest_vegetation(spark, sf_dir):
    """The 400 nearest of all vegetation sources together; the second source's even items are zones and count abroad only."""
    c = Warehouse(spark, sf_dir).candidates().select("cand_id", "source", F.hypot("lat", "lon").alias("dist"))
    first, second = c.where("source = 'ign'"), c.where("source = 'osm'")
    every = places.accumulated(first, second.where("cand_id % 2 = 1"), second.where("cand_id % 2 = 0"), F.lit(False))
    return places.nearest(every, 400, ("dist", "cand_id")).select("cand_id", "source", tidy("dist", 5).alias("dist"))


def source_counts(spark, sf_dir):
    """How many boxes are used, the study building itself, clipped and skipped."""
    found = polygons.resolved(boxes(Warehouse(spark, sf_dir)), STRIP)
    return places.source_stats(found.withColumn("used", F.col("status").isin("kept", "clipped") & (F.col("height") > 5)))


def setpoints_by_position(spark, sf_dir):
    """Hours with the setpoints of the same position, which win over the hours' own."""
    hours = weather_queries.assembled(Warehouse(spark, sf_dir)).select(F.col("hour_index").alias("seq"), "t_ext", F.lit(18.0).alias("t_min"))
    points = hours.select("seq", F.when(F.col("seq") % 24 < 7, 16.0).when(F.col("seq") % 24 < 20, 19.0).alias("t_min"), (26.0 + F.col("seq") % 3).alias("t_max"))
    return weather.zipped(hours, points).select("seq", tidy("t_ext").alias("t_ext"), "t_min", "t_max")


def local_offsets(spark, sf_dir):
    """Hour index of every kept hour at sites with UTC offsets of their own; sites without one count in UTC."""
    w = Warehouse(spark, sf_dir)
    probes = w.sites().where("site_id % 3 <> 0").select("site_id", (half_up(F.col("lon") / 15.0) * 3600).alias("utc_offset_seconds"))
    few = weather.with_offsets(w.sites().where("site_id <= 10").select("site_id"), probes, "site_id")
    hours = weather.kept_hours(weather.year(w.weather_raw())).select("hour_ts")
    at = few.crossJoin(F.broadcast(hours))  # a year of hours at most
    return weather.local_hour_index(at, F.col("utc_offset_s"), ("site_id",)).groupBy("site_id").agg(F.count(F.lit(1)).alias("n"), F.min("hour_index").alias("first_index"), F.max("hour_index").alias("last_index"))


def altitude_sources(spark, sf_dir):
    """Altitudes of sites from a first source that lacks some, so that the second answers, with request numbers."""
    sites = Warehouse(spark, sf_dir).sites().select(F.col("site_id").alias("seq"), "site_id", "lat")
    first, second = sites.where("site_id % 50 <> 7").select("site_id", F.col("lat").alias("altitude")), sites.select("site_id", (F.col("lat") + 100.0).alias("altitude"))
    return readers.altitudes(sites, first, second, ("site_id",), 7).select("site_id", "batch", tidy("altitude").alias("altitude"))


def floor_volumes(spark, sf_dir):
    """Floor area and volume of every mesh; group A is its floor."""
    shapes = meshes.with_geometry(Warehouse(spark, sf_dir).triangles()).where("not degenerate")
    return meshes.floor_volume(shapes, ("mesh_id",), F.lit(2.7), "A").select("mesh_id", tidy("floor_area", 4).alias("floor_area"), F.col("volume").cast("long").alias("volume"))


def group_selection(spark, sf_dir):
    """Groups by first appearance after the triangles of one group got another wall and boundary."""
    w = Warehouse(spark, sf_dir)
    changed = entities.set_where(w.triangles(), F.col("grp") == "N", {"wall_id": F.lit(-1).cast("long"), "boundary": F.lit("ground")})
    return changed.groupBy("grp").agg(F.min(F.col("mesh_id") * 10 + F.col("tri_id")).alias("first_seen"), F.count_if(F.col("wall_id") == -1).alias("n_set"), F.count_if(F.col("boundary") == "ground").alias("n_ground"))


def scene_transmittance(spark, sf_dir):
    """k of every object of two envelopes: their numbers never meet, and the first triangle of an object decides."""
    w = Warehouse(spark, sf_dir)
    t = w.triangles().select((F.col("mesh_id") * 10 + F.col("tri_id")).alias("tri_id"), (F.col("mesh_id") % 7).alias("obj"), ((F.col("mesh_id") * 3 + F.col("tri_id")) % 5 / 10.0).alias("k"), *[f"{c}{i}" for i in range(3) for c in "xyz"])
    scene = visibility.one_scene({"building": t.where("obj < 3"), "environment": t.where("obj >= 2")})
    return scene.where("k is not null").groupBy("obj").agg(F.count(F.lit(1)).alias("n"), tidy(F.min("k")).alias("least_k"), tidy(F.max("k")).alias("most_k"))


def chart_domains(spark, sf_dir):
    """Axis ends of each day's temperatures, and the hour under a chart position."""
    hours = weather_queries.assembled(Warehouse(spark, sf_dir)).withColumn("day", F.floor(F.col("hour_index") / 24))
    by_day = hours.groupBy("day").agg(F.min("t_ext").alias("low"), F.max("t_ext").alias("high"), F.count(F.lit(1)).alias("n"))
    (low, high), (low10, high10) = (display.domain(F.col("low"), F.col("high"), s) for s in (0.08, 0.1))
    hover = display.nearest_hour(F.col("day") * 20.0, F.lit(50.0), F.lit(600.0), F.col("n"))
    return by_day.select("day", tidy(low, 5).alias("low"), tidy(high, 5).alias("high"), tidy(low10, 5).alias("low10"), tidy(high10, 5).alias("high10"), hover.cast("long").alias("hover"))


def labels(spark, sf_dir):
    """Names, file stems, suggested flows and groups in common of the candidates."""
    c = Warehouse(spark, sf_dir).candidates()
    flow, recovery = display.suggested_flow(F.col("n_walls") * 10.5, 4)
    own = F.array(F.lit("staff"), F.concat(F.lit("g"), (F.col("cand_id") % 5).cast("string")), F.lit("g3"))
    return c.select(
        "cand_id", display.default_name(F.col("lat"), F.col("lon")).alias("name"), display.stem(F.concat(F.lit("Haus."), F.col("cand_id").cast("string"), F.when(F.col("cand_id") % 2 == 0, ".OBJ").otherwise(".stl"))).alias("stem"),
        tidy(flow, 4).alias("flow"), recovery.alias("recovery"), F.array_join(display.shared_groups(own, F.array(F.lit("g3"), F.lit("g1"))), ",").alias("shared"),
    )


def surface_films(spark, sf_dir):
    """Outer films by boundary and shutter, with the triangles that have them, and the sun on their wall."""
    t = meshes.with_geometry(Warehouse(spark, sf_dir).triangles()).where("not degenerate")
    film = physics.surface_film(F.lit(17.62), F.col("boundary"), F.lit(0.5), F.col("grp") == "A", F.when(F.col("wall_id") % 2 == 0, 0.2).otherwise(0.0))
    sun = physics.incident_on_wall(F.lit(500.0), F.lit(100.0), F.lit(30.0), F.col("tilt"), F.col("tilt"))
    return t.groupBy("boundary", "grp", tidy(film).alias("h_e")).agg(F.count(F.lit(1)).alias("n"), tidy(F.sum(sun) / 1000.0, 2).alias("sun_kw"))


def box_surfaces(spark, sf_dir):
    """Area of every group of a flat and a gabled box."""
    out = None
    for name, ridge in (("flat", None), ("gable", 1.5)):
        areas = meshes.with_geometry(meshes.gable_box(spark, 12.0, 8.0, 3.0, ridge)).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), tidy(F.sum("area"), 5).alias("area"), tidy(F.sum("nz"), 5).alias("up"))
        rows = areas.select(F.lit(name).alias("kind"), "grp", "n", "area", "up")
        out = rows if out is None else out.union(rows)
    return out


QUERIES = {f.__name__: f for f in (study_overlap, obstacle_admission, nearest_vegetation, source_counts, setpoints_by_position, local_offsets, altitude_sources, floor_volumes, group_selection, scene_transmittance, chart_domains, labels, surface_films, box_surfaces)}

BOXES = """b AS (SELECT cand_id AS item, CAST((cand_id % 40) * 15 AS DOUBLE) AS x, CAST((cand_id // 40) * 15 AS DOUBLE) AS y, CAST(4 + cand_id % 17 AS DOUBLE) AS a, CAST(4 + cand_id % 11 AS DOUBLE) AS c, n_walls / 4e0 AS height FROM v5)"""
MEET = lambda x0, y0, x1, y1: f"greatest(0e0, least(x + a, {x1}e0) - greatest(x, {x0}e0)) * greatest(0e0, least(y + c, {y1}e0) - greatest(y, {y0}e0))"
# Whole coordinates: any part that is left has 1 m2 at least.
RESOLVED = lambda overlap, whole: f"""{BOXES}, o AS (SELECT *, a * c AS area, {overlap} AS overlap FROM b),
s AS (SELECT *, CASE WHEN overlap <= 1e-9 THEN 'kept' WHEN overlap / (area + {whole}e0 - overlap) > 0.3e0 OR area - overlap < 1e-9 THEN 'self' ELSE 'clipped' END AS status FROM o)"""  # noqa: E731
ELL_SQL = RESOLVED(f"({MEET(100, 0, 160, 40)} + {MEET(100, 40, 130, 90)} - {MEET(110, 10, 120, 20)})", 60 * 40 + 30 * 50 - 100)
STRIP_SQL = RESOLVED(MEET(100, -10, 131, 4000), 31 * 4010)
ORACLES = {
    "study_overlap": with_views(f"WITH {ELL_SQL} SELECT item, status, area, overlap, CASE WHEN status = 'self' THEN 0e0 ELSE area - overlap END AS left_area FROM s", "v5"),
    "obstacle_admission": with_views(
        f"""WITH {STRIP_SQL}, p AS (SELECT item, sqrt(x * x + y * y) AS dist FROM s WHERE status <> 'self'), n AS (SELECT *, row_number() OVER (ORDER BY dist, item) AS k FROM p)
        SELECT item, 8 AS n_vertices, 12 AS n_triangles, CAST((k - 1) * 8 AS BIGINT) AS n_vertices_offset, CAST((k - 1) * 12 AS BIGINT) AS n_triangles_offset FROM n WHERE k * 12 <= 20000""", "v5"),
    "nearest_vegetation": with_views("SELECT cand_id, source, round(sqrt(lat * lat + lon * lon), 5) + 0e0 AS dist FROM v5 WHERE true ORDER BY sqrt(lat * lat + lon * lon), cand_id LIMIT 400", "v5"),
    "source_counts": with_views(
        f"""WITH {STRIP_SQL}, u AS (SELECT *, status <> 'self' AND height > 5 AS used FROM s) SELECT count(*) AS n_total, count(*) FILTER (WHERE used) AS n_used, count(*) FILTER (WHERE status = 'self') AS n_self,
        count(*) FILTER (WHERE status = 'clipped' AND used) AS n_clipped, count(*) - count(*) FILTER (WHERE used) - count(*) FILTER (WHERE status = 'self') AS n_skipped FROM u""", "v5"),
    "setpoints_by_position": with_views(
        f"""WITH {weather_queries.CLAMPED_SQL} SELECT hour_index AS seq, round(t_ext, 6) + 0e0 AS t_ext, CASE WHEN hour_index % 24 < 7 THEN 16e0 WHEN hour_index % 24 < 20 THEN 19e0 ELSE 18e0 END AS t_min,
        26e0 + hour_index % 3 AS t_max FROM w""", "v1"),
    "local_offsets": with_views(
        """WITH k AS (SELECT hour_ts FROM v1 WHERE t_ext_raw IS NOT NULL AND e_dir_raw IS NOT NULL AND e_dif_raw IS NOT NULL),
        l AS (SELECT site_id, hour_ts + to_seconds(CASE WHEN site_id % 3 = 0 THEN 0 ELSE CAST(floor(lon / 15e0 + 0.5e0) AS BIGINT) * 3600 END) AS t FROM v2 CROSS JOIN k WHERE site_id <= 10),
        f AS (SELECT site_id, CAST(min(t) AS DATE) AS d FROM l GROUP BY site_id), h AS (SELECT site_id, date_diff('day', d, CAST(t AS DATE)) * 24 + hour(t) AS i FROM l JOIN f USING (site_id))
        SELECT site_id, count(*) AS n, CAST(min(i) AS INT) AS first_index, CAST(max(i) AS INT) AS last_index FROM h GROUP BY 1""", "v1", "v2"),
    "altitude_sources": with_views("SELECT site_id, CAST(site_id // 7 AS INT) AS batch, round(lat + CASE WHEN (SELECT count(*) FROM v2 WHERE site_id % 50 = 7) > 0 THEN 100e0 ELSE 0e0 END, 6) + 0e0 AS altitude FROM v2", "v2"),
    "floor_volumes": with_views(
        """WITH c AS (SELECT mesh_id, grp, sqrt(power((y1-y0)*(z2-z0)-(z1-z0)*(y2-y0), 2) + power((z1-z0)*(x2-x0)-(x1-x0)*(z2-z0), 2) + power((x1-x0)*(y2-y0)-(y1-y0)*(x2-x0), 2)) AS n FROM v4),
        s AS (SELECT mesh_id, sum(CASE WHEN grp = 'A' THEN n / 2e0 ELSE 0e0 END) AS floor_area FROM c WHERE n >= 1e-12 GROUP BY 1)
        SELECT mesh_id, round(floor_area, 4) + 0e0 AS floor_area, CAST(floor(floor_area * 2.7e0 + 0.5e0) AS BIGINT) AS volume FROM s""", "v4"),
    "group_selection": with_views("SELECT grp, min(mesh_id * 10 + tri_id) AS first_seen, count(*) FILTER (WHERE grp = 'N') AS n_set, count(*) FILTER (WHERE grp = 'N' OR boundary = 'ground') AS n_ground FROM v4 GROUP BY 1", "v4"),
    "scene_transmittance": with_views(
        """WITH t AS (SELECT mesh_id * 10 + tri_id AS tri_id, mesh_id % 7 AS o, (mesh_id * 3 + tri_id) % 5 / 10e0 AS k FROM v4),
        u AS (SELECT 'building:' || o AS obj, tri_id, k FROM t WHERE o < 3 UNION ALL SELECT 'environment:' || o, tri_id, k FROM t WHERE o >= 2),
        f AS (SELECT obj, arg_min(k, tri_id) AS k, count(*) AS n FROM u WHERE k > 0 GROUP BY 1) SELECT obj, n, round(k, 6) + 0e0 AS least_k, round(k, 6) + 0e0 AS most_k FROM f""", "v4"),
    "chart_domains": with_views(
        f"""WITH {weather_queries.CLAMPED_SQL}, d AS (SELECT CAST(floor(hour_index / 24e0) AS BIGINT) AS day, min(t_ext) AS lo, max(t_ext) AS hi, count(*) AS n FROM w GROUP BY 1),
        h AS (SELECT *, CASE WHEN hi > lo THEN (hi - lo) * 0.08e0 ELSE 1.16e0 END AS p, CASE WHEN hi > lo THEN (hi - lo) * 0.1e0 ELSE 1e0 END AS q, CAST(floor((day * 20e0 - 50e0) / 600e0 * n + 0.5e0) AS BIGINT) AS hour FROM d)
        SELECT day, round(lo - p, 5) + 0e0 AS low, round(hi + p, 5) + 0e0 AS high, round(lo - q, 5) + 0e0 AS low10, round(hi + q, 5) + 0e0 AS high10, CASE WHEN hour BETWEEN 0 AND n THEN hour END AS hover FROM h""", "v1"),
    "labels": with_views(
        """SELECT cand_id, printf('Bâtiment %.5f, %.5f', lat, lon) AS name, 'Haus.' || cand_id AS stem, round(floor(n_walls * 10.5e0 * 0.5e0 * 10e0 + 0.5e0) / 10e0, 4) + 0e0 AS flow, 0.75e0 AS recovery,
        CASE WHEN cand_id % 5 = 1 THEN 'g1,g3' ELSE 'g3' END AS shared FROM v5""", "v5"),
    "surface_films": with_views(
        """WITH c AS (SELECT *, (y1-y0)*(z2-z0)-(z1-z0)*(y2-y0) AS p, (z1-z0)*(x2-x0)-(x1-x0)*(z2-z0) AS q, (x1-x0)*(y2-y0)-(y1-y0)*(x2-x0) AS r FROM v4),
        n AS (SELECT *, degrees(acos(greatest(-1e0, least(1e0, r / sqrt(p*p + q*q + r*r))))) AS tilt FROM c WHERE sqrt(p*p + q*q + r*r) >= 1e-12)
        SELECT boundary, grp, round(CASE WHEN boundary = 'ground' THEN 1e0 / 0.5e0 WHEN grp = 'A' AND wall_id % 2 = 0 THEN 1e0 / (1e0 / 17.62e0 + 0.2e0) ELSE 17.62e0 END, 6) + 0e0 AS h_e, count(*) AS n,
        round(sum(500e0 * greatest(0e0, cos(radians(tilt))) + 100e0 * (1e0 + cos(radians(tilt))) / 2e0) / 1000e0, 2) + 0e0 AS sun_kw FROM n GROUP BY 1, 2, 3""", "v4"),
    "box_surfaces": """SELECT kind, grp, n, round(area, 5) + 0e0 AS area, round(up, 5) + 0e0 AS up FROM (VALUES
        ('flat', 'sol', 2, 96e0, -2e0), ('flat', 'mur_est', 2, 36e0, 0e0), ('flat', 'mur_ouest', 2, 36e0, 0e0), ('flat', 'mur_sud', 2, 24e0, 0e0), ('flat', 'mur_nord', 2, 24e0, 0e0), ('flat', 'toiture', 2, 96e0, 2e0),
        ('gable', 'sol', 2, 96e0, -2e0), ('gable', 'mur_est', 2, 36e0, 0e0), ('gable', 'mur_ouest', 2, 36e0, 0e0), ('gable', 'mur_sud', 3, 30e0, 0e0), ('gable', 'mur_nord', 3, 30e0, 0e0),
        ('gable', 'toiture_est', 2, 12e0 * sqrt(18.25e0), 8e0 / sqrt(18.25e0)), ('gable', 'toiture_ouest', 2, 12e0 * sqrt(18.25e0), 8e0 / sqrt(18.25e0))) t(kind, grp, n, area, up)""",
}
