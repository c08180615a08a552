"""Queries on walls and meshes, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from calorix.functions import physics
from calorix.functions.rounding import tidy
from calorix.operators import meshes, refresh, walls
from calorix.sources.stage import folder
from calorix.sources.tables import Warehouse, with_views


def wall_u_value(spark, sf_dir):
    """Thermal transmittance of every wall."""
    return walls.u_values(Warehouse(spark, sf_dir).layers()).select("wall_id", tidy("u").alias("u"))


def wall_mesh_nodes(spark, sf_dir):
    """Nodes of all walls at 2 cm."""
    return walls.mesh_nodes(Warehouse(spark, sf_dir).layers(), 0.02).select("wall_id", "node", "layer_idx", tidy("x").alias("x"))


def solar_propagation(spark, sf_dir):
    """Where 800 W/m2 go in every wall."""
    return walls.solar_sources(Warehouse(spark, sf_dir).layers(), 800.0).select("wall_id", "layer_idx", *[tidy(c).alias(c) for c in ("surface", "volume", "interior")])


def constraint_rejects(spark, sf_dir):
    """Layers that break tightened bounds, with reasons."""
    bounds = walls.LAYER_BOUNDS | {"e": (0.01, 0.25), "rho": (0.0, 3000.0)}
    return walls.rejects(Warehouse(spark, sf_dir).layers(), bounds).select("wall_id", "layer_idx", "reasons")


def shapes(spark, sf_dir):
    return meshes.with_geometry(Warehouse(spark, sf_dir).triangles())


def triangle_geometry(spark, sf_dir):
    """Geometry of all triangles that have an area."""
    kept = shapes(spark, sf_dir).where("not degenerate")
    return kept.select("mesh_id", "tri_id", *[tidy(c, 5).alias(c) for c in ("area", "nx", "ny", "nz", "tilt", "azimuth")])


def h_i_by_tilt(spark, sf_dir):
    """Inner film coefficients with the triangles and area that have them."""
    kept = shapes(spark, sf_dir).where("not degenerate")
    return kept.groupBy(physics.inner_film(F.round("tilt", 6)).alias("h_i")).agg(F.count(F.lit(1)).alias("n"), tidy(F.sum("area"), 3).alias("area"))


def wall_fk_missing(spark, sf_dir):
    """Wall ids of triangles that the table of opaque walls lacks."""
    w = Warehouse(spark, sf_dir)
    return meshes.missing_keys(w.triangles(), w.layers().where("tau = 0"), "wall_id")


def frames(w: Warehouse):
    one = w.layers().where("layer_idx = 0")
    return one.select("wall_id", F.when(F.col("wall_id") % 5 == 0, 1.8).alias("frame_u"), F.when(F.col("wall_id") % 10 == 0, 0.25).alias("frame_fraction"))


def frame_split(spark, sf_dir):
    """Frame conductance and glazed area by wall."""
    split = meshes.split_frames(shapes(spark, sf_dir), frames(Warehouse(spark, sf_dir)))
    return split.groupBy("wall_id").agg(tidy(F.sum("g_frame"), 3).alias("g_frame"), tidy(F.sum("area"), 3).alias("area"))


#: Triangle numbers repeat within meshes, so the other columns break ties.
GLAZING_ORDER = ("tri_id", "wall_id", "x0", "y0", "z0", "x1", "y1")


def glazing_assign(spark, sf_dir):
    """Triangles that become glazing at 30 percent of each mesh and group."""
    return meshes.spread_evenly(shapes(spark, sf_dir), 0.3, ("mesh_id", "grp"), GLAZING_ORDER).where("glazed").select("mesh_id", "tri_id", "grp")


def glazing_share(spark, sf_dir):
    """Glazed share by group."""
    marked = meshes.spread_evenly(shapes(spark, sf_dir), 0.3, ("mesh_id", "grp"), GLAZING_ORDER)
    return meshes.glazed_shares(marked, ("grp",)).select("grp", tidy("glazed_pct", 4).alias("glazed_pct"))


def group_counts(spark, sf_dir):
    """Triangles, those with a known wall, ground triangles, walls and first triangle per group."""
    w = Warehouse(spark, sf_dir)
    known = w.layers().select("wall_id").distinct().withColumn("known", F.lit(True))
    return w.triangles().join(known, "wall_id", "left").groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("known")).alias("n_assigned"), F.count_if(F.col("boundary") == "ground").alias("n_ground"),
        F.count_distinct("wall_id").alias("n_walls"), F.min(F.col("mesh_id") * 10 + F.col("tri_id")).alias("first_seen"),
    )


def mesh_union_rebase(spark, sf_dir):
    """Vertex offset of each mesh in the union of all."""
    per_mesh = Warehouse(spark, sf_dir).triangles().groupBy("mesh_id").agg((F.count(F.lit(1)) * 3).alias("n_vertices"))
    return meshes.rebased(per_mesh, "mesh_id", "n_vertices").select("mesh_id", "vertex_offset")


def corners(w: Warehouse):
    one = lambda i: F.struct((F.col("tri_id") * 3 + i).alias("seq"), *[F.col(f"{c}{i}").alias(c) for c in "xyz"])
    return w.triangles().select("mesh_id", F.inline(F.array(*map(one, range(3)))))


def vertex_weld(spark, sf_dir):
    """Vertex ids of all triangle corners after welding."""
    return meshes.welded(corners(Warehouse(spark, sf_dir)), "mesh_id", "seq").select("mesh_id", "seq", "vertex")


RING = [(-12.0, -7.0), (13.0, -9.0), (8.0, 11.0), (-6.0, 14.0)]


def terrain_mesh(spark, sf_dir):
    """Faces of a terrain of 25 m radius whose heights are flattened under the footprint."""
    points, faces = meshes.terrain(spark, 25.0, 5.0)
    wave = F.when(meshes.inside_ring(F.col("x"), F.col("y"), RING), 0.0).otherwise(F.col("x") * 0.1 + F.col("y") * F.col("y") * 0.01)
    heights = points.select("vid", wave.alias("z"))
    out = faces
    for i in range(3):
        out = out.join(heights.select(F.col("vid").alias(f"v{i}"), F.col("z").alias(f"z{i}")), f"v{i}")
    return out.select("v0", "v1", "v2", *[tidy(f"z{i}").alias(f"z{i}") for i in range(3)])


def refine_mesh(spark, sf_dir):
    """Triangles and area of each mesh's connected pieces after refinement to 4 m."""
    w = Warehouse(spark, sf_dir)
    out = meshes.with_geometry(meshes.refined(meshes.with_pieces(w.triangles()), 4.0))
    return out.groupBy("mesh_id", "piece").agg(F.count(F.lit(1)).alias("n"), tidy(F.sum("area"), 4).alias("area"))


def refine_index(spark, sf_dir):
    """Vertices, faces, distinct edges, borders (edges of one face) and area of every mesh that is refined to 4 m as an indexed mesh."""
    whole = shapes(spark, sf_dir).where("not degenerate").drop("area", "tilt", "azimuth", "degenerate", "nx", "ny", "nz")
    return meshes.refined_figures(whole, 4.0).withColumn("area", tidy("area", 4))


def refreshed_areas(spark, sf_dir):
    """Area of every mesh after a first run over all and a second after every fiftieth has changed; which the second computed."""
    items, path = Warehouse(spark, sf_dir).triangles(), folder(spark, "areas")
    area = lambda rows: meshes.with_geometry(rows).groupBy("mesh_id").agg(F.sum("area").alias("area"))
    refresh.refresh(items, "mesh_id", area, path)
    moved = items.withColumn("z0", F.when(F.col("mesh_id") % 50 == 0, F.col("z0") + 1.0).otherwise(F.col("z0")))
    result, computed = refresh.refresh(moved, "mesh_id", area, path)
    again = computed.withColumn("computed", F.lit(True))
    return result.join(again, "mesh_id", "left").select("mesh_id", tidy("area", 4).alias("area"), F.coalesce("computed", F.lit(False)).alias("computed"))


def clip_obstacles(spark, sf_dir):
    """Status and outside area of candidate boxes against a study box."""
    k = F.col("cand_id")
    x, y = (k % 41 - 20).cast("double"), (k % 29 - 14).cast("double")
    boxes = Warehouse(spark, sf_dir).candidates().select("cand_id", x.alias("x0"), y.alias("y0"), (x + F.col("n_walls") % 17).alias("x1"), (y + F.col("n_walls") % 13).alias("y1"))
    return meshes.clipped_boxes(boxes, (-5.0, -4.0, 3.0, 2.0)).select("cand_id", "status", tidy(F.when(F.col("status").isin("kept", "clipped"), F.col("left")).otherwise(0.0)).alias("outside"))


def upsert_catalogue(spark, sf_dir):
    """Walls after an upsert of a shifted table."""
    w = Warehouse(spark, sf_dir)
    base = w.layers().where("layer_idx = 0").select("wall_id", "e", "lam")
    changes = base.where("e > 0.15").select((F.col("wall_id") + 30).alias("wall_id"), (F.col("e") * 2.0).alias("e"), F.col("lam"))
    return walls.upserted(base, changes, "wall_id").select("wall_id", tidy("e").alias("e"), tidy("lam").alias("lam"))


QUERIES = {f.__name__: f for f in (wall_u_value, wall_mesh_nodes, solar_propagation, constraint_rejects, triangle_geometry, h_i_by_tilt, wall_fk_missing, frame_split, glazing_assign, glazing_share, group_counts, mesh_union_rebase, vertex_weld, terrain_mesh, refine_mesh, refine_index, refreshed_areas, clip_obstacles, upsert_catalogue)}

GEOMETRY = """c AS (SELECT *, (y1-y0)*(z2-z0)-(z1-z0)*(y2-y0) AS cx_, (z1-z0)*(x2-x0)-(x1-x0)*(z2-z0) AS cy_, (x1-x0)*(y2-y0)-(y1-y0)*(x2-x0) AS cz_ FROM v4),
l AS (SELECT *, sqrt(cx_*cx_+cy_*cy_+cz_*cz_) AS len FROM c),
t AS (SELECT *, len/2e0 AS area, degrees(acos(greatest(-1e0, least(1e0, cz_/len)))) AS tilt, degrees(atan2(cx_/len, cy_/len)) AS az FROM l)"""
MARKED = f"""{GEOMETRY}, p AS (SELECT *, row_number() OVER (PARTITION BY mesh_id, grp ORDER BY tri_id, wall_id, x0, y0, z0, x1, y1) - 1 AS p FROM t),
m AS (SELECT *, floor((p+1)*0.3e0+0.5e0) > floor(p*0.3e0+0.5e0) AS glazed FROM p)"""

#: Connected pieces: triangles reach each other over edges between rounded corners; r has each triangle's piece and rounds.
PIECES = """t3 AS (SELECT *, [[floor(x0*1e5+0.5e0), floor(y0*1e5+0.5e0), floor(z0*1e5+0.5e0)], [floor(x1*1e5+0.5e0), floor(y1*1e5+0.5e0), floor(z1*1e5+0.5e0)], [floor(x2*1e5+0.5e0), floor(y2*1e5+0.5e0), floor(z2*1e5+0.5e0)]] AS corners FROM t),
q AS (SELECT *, [list_sort([corners[1], corners[2]]), list_sort([corners[2], corners[3]]), list_sort([corners[1], corners[3]])] AS edges FROM t3),
u AS (SELECT DISTINCT mesh_id, tri_id, edge FROM (SELECT mesh_id, tri_id, unnest(edges) AS edge FROM q) WHERE edge[1] <> edge[2]),
n AS (SELECT DISTINCT a.mesh_id, a.tri_id, b.tri_id AS other FROM u a JOIN u b ON a.mesh_id = b.mesh_id AND a.edge = b.edge AND a.tri_id <> b.tri_id),
p AS (SELECT DISTINCT mesh_id, tri_id, tri_id AS piece FROM n UNION SELECT n.mesh_id, n.other, p.piece FROM p JOIN n ON n.mesh_id = p.mesh_id AND n.tri_id = p.tri_id),
m AS (SELECT mesh_id, tri_id, min(piece) AS piece FROM p GROUP BY 1, 2),
o AS (SELECT q.*, coalesce(m.piece, q.tri_id) AS piece, greatest(sqrt(power(x1-x0,2)+power(y1-y0,2)+power(z1-z0,2)), sqrt(power(x2-x1,2)+power(y2-y1,2)+power(z2-z1,2)), sqrt(power(x2-x0,2)+power(y2-y0,2)+power(z2-z0,2))) AS long_edge
  FROM q LEFT JOIN m USING (mesh_id, tri_id)),
r AS (SELECT *, greatest(0, ceil(log2(max(long_edge) OVER (PARTITION BY mesh_id, piece) / 4e0))) AS rounds FROM o)"""


def ring_sql(ring: list[tuple[float, float]]) -> str:
    parts = []
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
        parts.append(f"CASE WHEN y >= {min(y0, y1)} AND y < {max(y0, y1)} AND x < {x0}e0 + (y - ({y0}e0)) * {(x1 - x0) / (y1 - y0)!r} THEN 1 ELSE 0 END")
    return "(" + " + ".join(parts) + ") % 2 = 1"


ORACLES = {
    "wall_u_value": with_views("SELECT wall_id, round(1e0 / (1e0/25e0 + sum(e/lam) + 1e0/7.7e0), 6) + 0e0 AS u FROM v3 GROUP BY wall_id", "v3"),
    "wall_mesh_nodes": with_views(
        """WITH n AS (SELECT *, CAST(greatest(1, ceil(e/0.02e0)) AS INT) AS n FROM v3), x AS (SELECT *, unnest(range(1, n+1)) AS el FROM n)
        SELECT wall_id, CAST(row_number() OVER w AS INT) AS node, layer_idx, round(sum(e/n) OVER w, 6) + 0e0 AS x FROM x
        WINDOW w AS (PARTITION BY wall_id ORDER BY layer_idx, el ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", "v3"),
    "solar_propagation": with_views(
        """WITH b AS (SELECT *, 800e0 * coalesce(product(tau) OVER w, 1e0) AS beam, coalesce(max(CASE WHEN tau <= 1e-9 THEN 1 ELSE 0 END) OVER w, 0) AS stopped,
          row_number() OVER (PARTITION BY wall_id ORDER BY layer_idx DESC) AS back FROM v3
          WINDOW w AS (PARTITION BY wall_id ORDER BY layer_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        a AS (SELECT *, CASE WHEN stopped = 0 AND beam > 1e-9 THEN alpha * beam ELSE 0e0 END AS absorbed FROM b)
        SELECT wall_id, layer_idx, round(CASE WHEN tau <= 1e-9 THEN absorbed ELSE 0e0 END, 6) + 0e0 AS surface, round(CASE WHEN tau > 1e-9 THEN absorbed ELSE 0e0 END, 6) + 0e0 AS volume,
        round(CASE WHEN back = 1 AND stopped = 0 AND tau > 1e-9 AND beam > 1e-9 AND beam * tau > 1e-9 THEN beam * tau ELSE 0e0 END, 6) + 0e0 AS interior FROM a""", "v3"),
    "constraint_rejects": with_views(
        """WITH r AS (SELECT wall_id, layer_idx, concat_ws(',', CASE WHEN NOT e BETWEEN 0.01e0 AND 0.25e0 THEN 'e' END, CASE WHEN NOT lam BETWEEN 0.001e0 AND 500e0 THEN 'lam' END,
          CASE WHEN NOT rho BETWEEN 0e0 AND 3000e0 THEN 'rho' END, CASE WHEN NOT c BETWEEN 0e0 AND 10000e0 THEN 'c' END, CASE WHEN abs(tau + r + alpha - 1e0) > 0.01e0 THEN 'optics' END) AS reasons FROM v3)
        SELECT * FROM r WHERE reasons <> ''""", "v3"),
    "triangle_geometry": with_views(
        f"""WITH {GEOMETRY} SELECT mesh_id, tri_id, round(area, 5) + 0e0 AS area, round(cx_/len, 5) + 0e0 AS nx, round(cy_/len, 5) + 0e0 AS ny, round(cz_/len, 5) + 0e0 AS nz,
        round(tilt, 5) + 0e0 AS tilt, round(CASE WHEN az < 0 THEN az + 360e0 ELSE az END, 5) + 0e0 AS azimuth FROM t WHERE len >= 1e-12""", "v4"),
    "h_i_by_tilt": with_views(f"WITH {GEOMETRY} SELECT CASE WHEN round(tilt, 6) <= 60 THEN 10e0 WHEN round(tilt, 6) >= 120 THEN 5.9e0 ELSE 7.7e0 END AS h_i, count(*) AS n, round(sum(area), 3) + 0e0 AS area FROM t WHERE len >= 1e-12 GROUP BY 1", "v4"),
    "wall_fk_missing": with_views("SELECT wall_id, count(*) AS n FROM v4 WHERE wall_id NOT IN (SELECT wall_id FROM v3 WHERE tau = 0) GROUP BY wall_id", "v3", "v4"),
    "frame_split": with_views(
        f"""WITH {GEOMETRY}, f AS (SELECT t.wall_id, area, EXISTS (SELECT 1 FROM v3 WHERE v3.wall_id = t.wall_id AND layer_idx = 0 AND v3.wall_id % 10 = 0) AS framed FROM t)
        SELECT wall_id, round(sum(CASE WHEN framed THEN 0.25e0 * 1.8e0 * area ELSE 0e0 END), 3) + 0e0 AS g_frame, round(sum(CASE WHEN framed THEN area * 0.75e0 ELSE area END), 3) + 0e0 AS area FROM f GROUP BY wall_id""", "v3", "v4"),
    "glazing_assign": with_views(f"WITH {MARKED} SELECT mesh_id, tri_id, grp FROM m WHERE glazed", "v4"),
    "glazing_share": with_views(f"WITH {MARKED} SELECT grp, round(sum(CASE WHEN glazed THEN area ELSE 0e0 END) * 100e0 / sum(area), 4) + 0e0 AS glazed_pct FROM m GROUP BY grp", "v4"),
    "group_counts": with_views(
        """SELECT grp, count(*) AS n, count(*) FILTER (WHERE wall_id IN (SELECT wall_id FROM v3)) AS n_assigned, count(*) FILTER (WHERE boundary = 'ground') AS n_ground,
        count(DISTINCT wall_id) AS n_walls, min(mesh_id * 10 + tri_id) AS first_seen FROM v4 GROUP BY grp""", "v3", "v4"),
    "mesh_union_rebase": with_views(
        """WITH m AS (SELECT mesh_id, count(*) * 3 AS n FROM v4 GROUP BY mesh_id)
        SELECT mesh_id, CAST(coalesce(sum(n) OVER (ORDER BY mesh_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS vertex_offset FROM m""", "v4"),
    "vertex_weld": with_views(
        """WITH c AS (SELECT mesh_id, tri_id*3 AS seq, x0 AS x, y0 AS y, z0 AS z FROM v4 UNION ALL SELECT mesh_id, tri_id*3+1, x1, y1, z1 FROM v4 UNION ALL SELECT mesh_id, tri_id*3+2, x2, y2, z2 FROM v4),
        f AS (SELECT *, min(seq) OVER (PARTITION BY mesh_id, floor(x*1e5+0.5e0), floor(y*1e5+0.5e0), floor(z*1e5+0.5e0)) AS first_seq FROM c)
        SELECT mesh_id, seq, CAST(dense_rank() OVER (PARTITION BY mesh_id ORDER BY first_seq) - 1 AS INT) AS vertex FROM f""", "v4"),
    "terrain_mesh": f"""WITH p AS (SELECT CAST(i AS INT) AS vid, -25e0 + (i % 11) * 5e0 AS x, -25e0 + floor(i / 11) * 5e0 AS y FROM range(121) r(i)),
        h AS (SELECT vid, CASE WHEN {ring_sql(RING)} THEN 0e0 ELSE x * 0.1e0 + y * y * 0.01e0 END AS z FROM p),
        a AS (SELECT CAST(floor(i / 10) * 11 + i % 10 AS INT) AS a FROM range(100) r(i)),
        f AS (SELECT a AS v0, a + 1 AS v1, a + 12 AS v2 FROM a UNION ALL SELECT a, a + 12, a + 11 FROM a)
        SELECT v0, v1, v2, round(h0.z, 6) + 0e0 AS z0, round(h1.z, 6) + 0e0 AS z1, round(h2.z, 6) + 0e0 AS z2 FROM f JOIN h h0 ON h0.vid = v0 JOIN h h1 ON h1.vid = v1 JOIN h h2 ON h2.vid = v2""",
    "refine_mesh": with_views(
        f"""WITH {GEOMETRY}, {PIECES}
        SELECT mesh_id, piece, CAST(sum(power(4, rounds)) AS BIGINT) AS n, round(sum(area), 4) + 0e0 AS area FROM r GROUP BY 1, 2""", "v4", recursive=True),
    "refine_index": with_views(
        f"""WITH {GEOMETRY.replace("FROM c)", "FROM c WHERE sqrt(cx_*cx_+cy_*cy_+cz_*cz_) >= 1e-9)")}, {PIECES},
        f AS (SELECT mesh_id, count(*) AS faces, sum(power(4, rounds)) AS n_faces, sum((power(2, rounds) - 1) * (power(2, rounds) - 2) / 2) AS inner_v, sum(3 * power(2, rounds) * (power(2, rounds) - 1) / 2) AS inner_e, sum(area) AS area FROM r GROUP BY 1),
        v AS (SELECT mesh_id, count(*) AS v FROM (SELECT DISTINCT mesh_id, unnest(corners) AS p FROM t3) GROUP BY 1),
        s AS (SELECT mesh_id, edge, max(rounds) AS rounds, count(*) AS n FROM (SELECT mesh_id, rounds, unnest(edges) AS edge FROM r) GROUP BY 1, 2),
        e AS (SELECT mesh_id, sum(power(2, rounds) - 1) AS new_v, sum(power(2, rounds)) AS n, sum(CASE WHEN n = 1 THEN power(2, rounds) ELSE 0 END) AS borders FROM s GROUP BY 1)
        SELECT mesh_id, CAST(v + new_v + inner_v AS BIGINT) AS n_vertices, CAST(n_faces AS BIGINT) AS n_faces, CAST(n + inner_e AS BIGINT) AS n_edges, CAST(borders AS BIGINT) AS n_borders, round(area, 4) + 0e0 AS area
        FROM f JOIN v USING (mesh_id) JOIN e USING (mesh_id)""", "v4", recursive=True),
    "refreshed_areas": with_views(
        """WITH m AS (SELECT mesh_id, CASE WHEN mesh_id % 50 = 0 THEN z0 + 1e0 ELSE z0 END AS z0, z1, z2, x0, x1, x2, y0, y1, y2 FROM v4),
        a AS (SELECT mesh_id, sqrt(power((y1-y0)*(z2-z0)-(z1-z0)*(y2-y0), 2) + power((z1-z0)*(x2-x0)-(x1-x0)*(z2-z0), 2) + power((x1-x0)*(y2-y0)-(y1-y0)*(x2-x0), 2)) / 2e0 AS area FROM m)
        SELECT mesh_id, round(sum(area), 4) + 0e0 AS area, mesh_id % 50 = 0 AS computed FROM a GROUP BY mesh_id""", "v4"),
    "clip_obstacles": with_views(
        """WITH b AS (SELECT cand_id, CAST(cand_id % 41 - 20 AS DOUBLE) AS x0, CAST(cand_id % 29 - 14 AS DOUBLE) AS y0, CAST(n_walls % 17 AS DOUBLE) AS w, CAST(n_walls % 13 AS DOUBLE) AS h FROM v5),
        o AS (SELECT *, w * h AS area, greatest(0e0, least(x0 + w, 3e0) - greatest(x0, -5e0)) * greatest(0e0, least(y0 + h, 2e0) - greatest(y0, -4e0)) AS overlap FROM b),
        s AS (SELECT *, CASE WHEN area < 1e-9 THEN 'degenerate' WHEN overlap <= 1e-9 THEN 'kept' WHEN overlap / (area + 48e0 - overlap) > 0.3e0 OR area - overlap < 1e0 THEN 'self' ELSE 'clipped' END AS status FROM o)
        SELECT cand_id, status, round(CASE WHEN status IN ('kept', 'clipped') THEN area - overlap ELSE 0e0 END, 6) + 0e0 AS outside FROM s""", "v5"),
    "upsert_catalogue": with_views(
        """WITH b AS (SELECT wall_id, e, lam FROM v3 WHERE layer_idx = 0), c AS (SELECT wall_id + 30 AS wall_id, e * 2e0 AS e, lam FROM b WHERE e > 0.15e0)
        SELECT wall_id, round(CASE WHEN c.wall_id IS NOT NULL THEN c.e ELSE b.e END, 6) + 0e0 AS e, round(CASE WHEN c.wall_id IS NOT NULL THEN c.lam ELSE b.lam END, 6) + 0e0 AS lam
        FROM b FULL OUTER JOIN c USING (wall_id)""", "v3"),
}
