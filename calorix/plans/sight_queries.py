"""Queries on visibility, with cross-join oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from calorix.functions.rounding import tidy
from calorix.functions.solar import direction
from calorix.operators import meshes, shadow_tiles, visibility
from calorix.plans import weather_queries
from calorix.sources.stage import written
from calorix.sources.tables import Warehouse, with_views


def panels(w: Warehouse):
    """Obstacles as 4 m x 4 m level panels of two triangles."""
    x, y = F.col("cx"), F.col("cy")
    p = [(x - 2.0, y - 2.0), (x + 2.0, y - 2.0), (x + 2.0, y + 2.0), (x - 2.0, y + 2.0)]
    tri = lambda half, *ids: F.struct(F.lit(half).alias("half"), *[c.alias(n) for i, k in enumerate(ids) for c, n in ((p[k][0], f"x{i}"), (p[k][1], f"y{i}"), (F.col("cz"), f"z{i}"))])
    two = w.obstacles().select("obj", "k", F.inline(F.array(tri(0, 0, 1, 2), tri(1, 0, 2, 3))))
    return visibility.with_origins(meshes.with_geometry(two))


KEY = ("src", "half", "az_idx", "el_idx")


def grid_rays(w: Warehouse):
    surfaces = panels(w).select(F.col("obj").alias("src"), "half", "ox", "oy", "oz", "nx", "ny", "nz", "tilt")
    return written(visibility.facing(surfaces, visibility.sun_grid(w.spark)), "rays")  # read for the hits and again for the result


def sun_grid_cull(spark, sf_dir):
    """Triangle and grid-direction pairs that face each other."""
    faces = meshes.with_geometry(Warehouse(spark, sf_dir).triangles()).where("not degenerate").select("wall_id", "nx", "ny", "nz")
    seen = visibility.facing(faces, visibility.sun_grid(spark), 1e-3)
    return seen.groupBy("az_idx", "el_idx").agg(F.count(F.lit(1)).alias("n"), tidy(F.sum("cos"), 2).alias("cos_sum"))


def grid_hits(w: Warehouse, rays):
    return visibility.hits(rays, panels(w), KEY, ("az_idx", "el_idx"), visibility.sun_grid(w.spark))


def ray_occlusion(spark, sf_dir):
    """Rays of the sun grid that no opaque panel blocks."""
    w = Warehouse(spark, sf_dir)
    rays = grid_rays(w)
    blocked = grid_hits(w, rays).where("k is null or k <= 0").select(*KEY).distinct()
    return rays.join(blocked, list(KEY), "left_anti").select(*KEY)


def visibility_cube(w: Warehouse):
    rays = grid_rays(w)
    return visibility.visible_fraction(rays, grid_hits(w, rays), KEY)


def vegetation_transmittance(spark, sf_dir):
    """Visible fraction of every facing ray."""
    return visibility_cube(Warehouse(spark, sf_dir)).select(*KEY, tidy("frac").alias("frac"))


def sky_view_factor(spark, sf_dir):
    """Sky view of every panel with the others in the way."""
    w = Warehouse(spark, sf_dir)
    directions = visibility.sky_directions(spark)
    surfaces = panels(w).select(F.col("obj").alias("src"), "half", "ox", "oy", "oz", "nx", "ny", "nz", "tilt")
    rays = written(visibility.facing(surfaces, directions, 1e-9), "rays")
    met = visibility.hits(rays, panels(w), ("src", "half", "dir"), ("dir",), directions)
    open_ = visibility.visible_fraction(rays, met, ("src", "half", "dir"), None)
    return visibility.sky_factors(open_, ("src", "half")).select("src", "half", tidy("f_sky", 5).alias("f_sky"))


def visibility_lookup(spark, sf_dir):
    """Mean visible fraction per panel over all sunlit hours of all sites, by nearest grid cell."""
    w = Warehouse(spark, sf_dir)
    az, el = visibility.nearest_cell(tidy("azimuth", 5), tidy("elevation", 5))
    # The hours collapse to their grid cells before they meet the panels.
    cells = weather_queries.sun(w).where("elevation > 0").groupBy(az.alias("az_idx"), el.alias("el_idx")).agg(F.count(F.lit(1)).alias("hours"))
    cube = visibility_cube(w).join(cells, ["az_idx", "el_idx"])
    return cube.groupBy("src", "half").agg(F.sum("hours").cast("long").alias("hours"), tidy(F.sum(F.col("frac") * F.col("hours")) / F.sum("hours"), 5).alias("mean_frac"))


def obstacle_union(spark, sf_dir):
    """Panels and candidate boxes in one list by distance, within the cap of 20 000 triangles, with offsets."""
    from calorix.operators import places

    w = Warehouse(spark, sf_dir)
    boxes = w.candidates().select(F.lit("building").alias("kind"), F.col("cand_id").alias("item"), F.hypot("lat", "lon").alias("dist"), (F.col("n_walls") * 4 - 4).cast("long").alias("n"))
    plates = w.obstacles().select(F.lit("panel").alias("kind"), F.col("obj").cast("long").alias("item"), F.hypot("cx", "cy").alias("dist"), F.lit(2).cast("long").alias("n"))
    kept = places.admitted(boxes.unionByName(plates), ("n",), (20_000,), ("dist", "kind", "item"))
    return kept.select("kind", "item", "n_offset")



#: Places in the city of meshes: columns, and the size of a tile; the sun's three directions (azimuth, elevation).
TILES, TILE_X, TILE_Y = 128, 64.0, 16.0
SUNS = ((40.0, 50.0), (160.0, 65.0), (275.0, 55.0))


def city(w: Warehouse):
    """All triangles that have an area, each mesh on a tile of its own."""
    column, row = (F.col("mesh_id") % TILES) * TILE_X, F.floor(F.col("mesh_id") / TILES) * TILE_Y
    moved = w.triangles().withColumns({**{f"x{i}": F.col(f"x{i}") + column for i in range(3)}, **{f"y{i}": F.col(f"y{i}") + row for i in range(3)}})
    return meshes.with_geometry(moved).where("not degenerate").withColumns({"obj": F.col("mesh_id"), "k": F.lit(None).cast("double")})


def city_occlusion(spark, sf_dir):
    """Of a scene of all triangles: each mesh's rays towards three suns, how many meet a triangle, and the mean distance to the first."""
    suns = spark.createDataFrame([(i, *map(float, a)) for i, a in enumerate(SUNS)], "sun int, az double, el double")
    towards = [tuple(r) for r in suns.select("sun", *direction(F.col("az"), F.col("el"))).orderBy("sun").drop("sun").collect()]  # of SUNS
    found = shadow_tiles.occlusion(city(Warehouse(spark, sf_dir)), towards, 1e-3)
    return found.select("mesh_id", "n_rays", "n_blocked", tidy("mean_distance", 4).alias("mean_distance"))


QUERIES = {f.__name__: f for f in (sun_grid_cull, ray_occlusion, vegetation_transmittance, sky_view_factor, visibility_lookup, obstacle_union, city_occlusion)}

PANELS = """pn AS (SELECT obj, k, 0 AS ph, cx-2e0 AS x0, cy-2e0 AS y0, cx+2e0 AS x1, cy-2e0 AS y1, cx+2e0 AS x2, cy+2e0 AS y2, cz AS z FROM v6
  UNION ALL SELECT obj, k, 1, cx-2e0, cy-2e0, cx+2e0, cy+2e0, cx-2e0, cy+2e0, cz FROM v6),
oo AS (SELECT obj AS src, ph AS half, (x0+x1+x2)/3e0 AS ox, (y0+y1+y2)/3e0 AS oy, z + 1e-3 AS oz FROM pn)"""
GRID = """gg AS (SELECT CAST(i % 24 AS INT) AS az_idx, CAST(i // 24 AS INT) AS el_idx, sin(radians((i % 24)*15e0))*cos(radians((i // 24)*15e0)) AS sx,
  cos(radians((i % 24)*15e0))*cos(radians((i // 24)*15e0)) AS sy, sin(radians((i // 24)*15e0)) AS sz FROM range(168) t(i))"""
# A level panel is met where the ray reaches its height inside the triangle.
HITS = """hh AS (SELECT {key}, pn.obj, pn.k FROM r JOIN pn ON r.sz > 1e-12 AND (pn.z - r.oz)/r.sz > 1e-9
  AND (pn.x1-pn.x0)*((r.oy + r.sy*(pn.z-r.oz)/r.sz)-pn.y0) - (pn.y1-pn.y0)*((r.ox + r.sx*(pn.z-r.oz)/r.sz)-pn.x0) >= 0
  AND (pn.x2-pn.x1)*((r.oy + r.sy*(pn.z-r.oz)/r.sz)-pn.y1) - (pn.y2-pn.y1)*((r.ox + r.sx*(pn.z-r.oz)/r.sz)-pn.x1) >= 0
  AND (pn.x0-pn.x2)*((r.oy + r.sy*(pn.z-r.oz)/r.sz)-pn.y2) - (pn.y0-pn.y2)*((r.ox + r.sx*(pn.z-r.oz)/r.sz)-pn.x2) >= 0),
bb AS (SELECT {key}, obj, bool_or(k IS NULL) AS opaque, max(k) AS k FROM hh GROUP BY {key}, obj),
ff AS (SELECT {key}, CASE WHEN bool_or(opaque) THEN 0e0 ELSE product(k) END AS frac FROM bb GROUP BY {key})"""
K4 = "src, half, az_idx, el_idx"
CUBE = f"""{PANELS}, {GRID}, r AS (SELECT oo.*, gg.* FROM oo CROSS JOIN gg WHERE sz > 1e-6), {HITS.format(key=K4)},
qq AS (SELECT r.src, r.half, r.az_idx, r.el_idx, round_even(coalesce(frac, 1e0), 3) AS frac FROM r LEFT JOIN ff USING (src, half, az_idx, el_idx))"""
# No ray leaves the height of the scene (under 14 m) before it is past the next tile.
CITY = f"""ct AS (SELECT mesh_id, mesh_id % {TILES} AS ci, mesh_id // {TILES} AS cj, x0 + (mesh_id % {TILES}) * {TILE_X}e0 AS x0, x1 + (mesh_id % {TILES}) * {TILE_X}e0 AS x1, x2 + (mesh_id % {TILES}) * {TILE_X}e0 AS x2,
  y0 + (mesh_id // {TILES}) * {TILE_Y}e0 AS y0, y1 + (mesh_id // {TILES}) * {TILE_Y}e0 AS y1, y2 + (mesh_id // {TILES}) * {TILE_Y}e0 AS y2, z0, z1, z2 FROM v4),
cn AS (SELECT *, (y1-y0)*(z2-z0)-(z1-z0)*(y2-y0) AS cx_, (z1-z0)*(x2-x0)-(x1-x0)*(z2-z0) AS cy_, (x1-x0)*(y2-y0)-(y1-y0)*(x2-x0) AS cz_ FROM ct),
cl AS (SELECT *, sqrt(cx_*cx_+cy_*cy_+cz_*cz_) AS len FROM cn),
cf AS (SELECT *, row_number() OVER () AS src, (x0+x1+x2)/3e0 + 1e-3 * (cx_/len) AS ox, (y0+y1+y2)/3e0 + 1e-3 * (cy_/len) AS oy, (z0+z1+z2)/3e0 + 1e-3 * (cz_/len) AS oz FROM cl WHERE len >= 1e-12),
su AS (SELECT sun, sin(radians(az))*cos(radians(el)) AS sx, cos(radians(az))*cos(radians(el)) AS sy, sin(radians(el)) AS sz FROM (VALUES {", ".join(f"({i}, {a}e0, {e}e0)" for i, (a, e) in enumerate(SUNS))}) t(sun, az, el)),
cr AS (SELECT src, sun, mesh_id, ci, cj, ox, oy, oz, sx, sy, sz FROM cf CROSS JOIN su WHERE (cx_/len)*sx + (cy_/len)*sy + (cz_/len)*sz > 1e-3),
nb AS (SELECT a.i AS di, b.i AS dj FROM range(-1, 2) a(i), range(-1, 2) b(i)),
cd AS (SELECT r.src, r.sun, f.x0, f.y0, f.z0, f.x1-f.x0 AS ax, f.y1-f.y0 AS ay, f.z1-f.z0 AS az, f.x2-f.x0 AS bx, f.y2-f.y0 AS by_, f.z2-f.z0 AS bz, r.ox-f.x0 AS tx, r.oy-f.y0 AS ty, r.oz-f.z0 AS tz, sx, sy, sz
  FROM cr r CROSS JOIN nb JOIN cf f ON f.ci = r.ci + nb.di AND f.cj = r.cj + nb.dj),
cp AS (SELECT *, sy*bz - sz*by_ AS px, sz*bx - sx*bz AS py, sx*by_ - sy*bx AS pz, ty*az - tz*ay AS qx, tz*ax - tx*az AS qy, tx*ay - ty*ax AS qz FROM cd),
ce AS (SELECT *, ax*px + ay*py + az*pz AS det FROM cp),
ch AS (SELECT src, sun, min((bx*qx + by_*qy + bz*qz)/det) AS first FROM ce WHERE abs(det) > 1e-12 AND (tx*px + ty*py + tz*pz)/det >= 0 AND (sx*qx + sy*qy + sz*qz)/det >= 0
  AND (tx*px + ty*py + tz*pz)/det + (sx*qx + sy*qy + sz*qz)/det <= 1 AND (bx*qx + by_*qy + bz*qz)/det > 1e-9 GROUP BY 1, 2)"""
ORACLES = {
    "city_occlusion": with_views(f"WITH {CITY} SELECT mesh_id, count(*) AS n_rays, count(first) AS n_blocked, round(avg(first), 4) + 0e0 AS mean_distance FROM cr LEFT JOIN ch USING (src, sun) GROUP BY 1", "v4"),
    "sun_grid_cull": with_views(
        f"""WITH c AS (SELECT (y1-y0)*(z2-z0)-(z1-z0)*(y2-y0) AS a, (z1-z0)*(x2-x0)-(x1-x0)*(z2-z0) AS b, (x1-x0)*(y2-y0)-(y1-y0)*(x2-x0) AS c FROM v4),
        n AS (SELECT a/sqrt(a*a+b*b+c*c) AS nx, b/sqrt(a*a+b*b+c*c) AS ny, c/sqrt(a*a+b*b+c*c) AS nz FROM c WHERE sqrt(a*a+b*b+c*c) >= 1e-12), {GRID}
        SELECT az_idx, el_idx, count(*) AS n, round(sum(nx*sx+ny*sy+nz*sz), 2) + 0e0 AS cos_sum FROM n CROSS JOIN gg WHERE nx*sx+ny*sy+nz*sz > 1e-3 GROUP BY 1, 2""", "v4"),
    "ray_occlusion": with_views(f"WITH {CUBE} SELECT {K4} FROM r ANTI JOIN (SELECT DISTINCT {K4} FROM hh WHERE k IS NULL) USING ({K4})", "v6"),
    "vegetation_transmittance": with_views(f"WITH {CUBE} SELECT {K4}, round(frac, 6) + 0e0 AS frac FROM qq", "v6"),
    "sky_view_factor": with_views(
        f"""WITH {PANELS}, d AS (SELECT CAST(i AS INT) AS dir, sqrt(greatest(0e0, 1e0-(1e0-2e0*i/127e0)*(1e0-2e0*i/127e0)))*cos(i*pi()*(3e0-sqrt(5e0))) AS sx, 1e0-2e0*i/127e0 AS sy,
          sqrt(greatest(0e0, 1e0-(1e0-2e0*i/127e0)*(1e0-2e0*i/127e0)))*sin(i*pi()*(3e0-sqrt(5e0))) AS sz FROM range(128) t(i)),
        r AS (SELECT oo.*, d.* FROM oo CROSS JOIN d WHERE sz > 1e-9), {HITS.format(key='src, half, dir')}
        SELECT r.src, r.half, round(sum(sz * coalesce(frac, 1e0)) / sum(sz), 5) + 0e0 AS f_sky FROM r LEFT JOIN ff USING (src, half, dir) GROUP BY 1, 2""", "v6"),
    "visibility_lookup": with_views(
        f"""WITH {weather_queries.CLAMPED_SQL}, s AS (SELECT * FROM v2), {weather_queries.SUN_SQL},
        n AS (SELECT CAST(CAST(round_even(round(azimuth, 5) / 15e0, 0) AS BIGINT) % 24 AS INT) AS az_idx, CAST(ceil(least(90e0, round(elevation, 5)) / 15e0 - 0.5e0) AS INT) AS el_idx, count(*) AS hours FROM z WHERE elevation > 0 GROUP BY 1, 2),
        {CUBE} SELECT src, half, CAST(sum(hours) AS BIGINT) AS hours, round(sum(frac * hours) / sum(hours), 5) + 0e0 AS mean_frac FROM qq JOIN n USING (az_idx, el_idx) GROUP BY 1, 2""", "v1", "v2", "v6"),
    "obstacle_union": with_views(
        """WITH u AS (SELECT 'building' AS kind, cand_id AS item, sqrt(lat*lat+lon*lon) AS dist, CAST(n_walls*4-4 AS BIGINT) AS n FROM v5
          UNION ALL SELECT 'panel', CAST(obj AS BIGINT), sqrt(cx*cx+cy*cy), 2 FROM v6),
        t AS (SELECT *, sum(n) OVER (ORDER BY dist, kind, item) AS s FROM u) SELECT kind, item, CAST(s - n AS BIGINT) AS n_offset FROM t WHERE s <= 20000""", "v5", "v6"),
}


def height_resolve(spark, sf_dir):
    """Heights from free-text measures: the number, else storeys, else the default, and crown radii."""
    from calorix.sources import readers

    events = Warehouse(spark, sf_dir).table("events")
    h = readers.first_number(F.col("props"))
    height, rough = readers.height_of(h, F.col("user_id") % 7 + 0.0)
    radius = readers.crown_radius(h, F.col("value"))
    return events.select("event_id", tidy(height, 4).alias("height"), rough.alias("approx"), tidy(radius, 4).alias("radius"))


QUERIES["height_resolve"] = height_resolve
ORACLES["height_resolve"] = """WITH v AS (SELECT event_id, nullif(CAST(nullif(regexp_extract(props, '([-+]?\\d*\\.?\\d+)', 1), '') AS DOUBLE), 0e0) AS h,
  nullif(CAST(user_id % 7 AS DOUBLE), 0e0) AS s, nullif(value, 0e0) AS c FROM events)
SELECT event_id, round(coalesce(h, s * 3e0, 6e0), 4) + 0e0 AS height, h IS NULL AS approx,
round(coalesce(h / 2e0, CASE WHEN c IS NOT NULL THEN greatest(1.5e0, least(8e0, c * 2.5e0)) END, 3e0), 4) + 0e0 AS radius FROM v"""
