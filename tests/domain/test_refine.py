"""Indexed refinement: no crack, same triangles as cutting in four, numbers without gaps."""

import itertools
import random
import tempfile

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from calorix.operators import meshes, places, prefix, refinement
from calorix.plans import mesh_queries
from calorix.sources import stage

CORNERS = "mesh_id long, tri_id long, grp string, " + ", ".join(f"{c}{i} double" for i in range(3) for c in "xyz")


def triangles(spark):
    """A closed tetrahedron, a strip of two triangles, a lone small triangle, and a mesh that needs no cut."""
    p = [(0.0, 0.0, 0.0), (9.0, 0.0, 0.0), (0.0, 7.0, 0.0), (1.0, 1.0, 5.0)]
    faces = [(1, i, "t", *[p[k] for k in f]) for i, f in enumerate([(0, 2, 1), (0, 1, 3), (1, 2, 3), (2, 0, 3)])]
    faces += [(1, 10, "s", (50.0, 0.0, 0.0), (53.0, 0.0, 0.0), (53.0, 3.0, 0.0)), (1, 11, "s", (53.0, 3.0, 0.0), (50.0, 3.0, 0.0), (50.0, 0.0, 0.0))]
    faces += [(1, 20, "l", (80.0, 0.0, 0.0), (80.5, 0.0, 0.0), (80.0, 0.5, 0.0)), (2, 0, "n", (0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0))]
    return spark.createDataFrame([(m, i, g, *itertools.chain(*c)) for m, i, g, *c in faces], CORNERS)


def test_refined_index(spark):
    pieces = meshes.with_pieces(triangles(spark))
    vertices, faces = meshes.refined_index(pieces, 2.5)
    at = {(r["mesh_id"], r["vertex"]): (r["x"], r["y"], r["z"]) for r in vertices.collect()}
    rows = faces.collect()
    for m in (1, 2):
        ids = sorted(v for k, v in at if k == m)
        assert ids == list(range(len(ids))), "numbers have no gaps"
        places_ = [tuple(round(x, 9) for x in at[m, v]) for v in ids]
        assert len(set(places_)) == len(places_), "no place is numbered twice"
    loose = meshes.refined(pieces, 2.5).collect()
    one = lambda m, corners: (m, *min(tuple(corners[i:] + corners[:i]) for i in range(3)))
    got = sorted(one(r["mesh_id"], [tuple(round(x, 9) for x in at[r["mesh_id"], r[f"v{i}"]]) for i in range(3)]) for r in rows)
    want = sorted(one(r["mesh_id"], [tuple(round(r[f"{c}{i}"], 9) for c in "xyz") for i in range(3)]) for r in loose)
    assert got == want, "the same triangles, turned the same way"
    sides = {}
    for r in rows:
        if r["grp"] == "t":
            for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0")):
                sides[r[a], r[b]] = sides.get((r[a], r[b]), 0) + 1
    assert all(n == 1 and (b, a) in sides for (a, b), n in sides.items()), "a closed surface stays closed"


def test_faces_without_three_corners(spark):
    flat = spark.createDataFrame([(1, 0, "g", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0)], CORNERS)
    vertices, faces = meshes.indexed(flat)
    assert faces.count() == 0 and vertices.count() == 2


def test_admitted_by_group_of_any_size(spark):
    items = spark.range(5000).select((F.col("id") % 3 == 0).alias("g"), "id", F.lit(2).alias("n"))
    kept = places.admitted(items, ("n",), (1000,), ("id",), ("g",))
    assert {(r["g"], r["k"], r["o"]) for r in kept.groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.max("n_offset").alias("o")).collect()} == {(True, 500, 998), (False, 500, 998)}


def test_inner_edges_of_faces_with_the_same_corners(spark, tmp_path):
    """Two faces that lie on each other share their sides, but each has inner edges of its own."""
    line = "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string"
    twice = [(1, n, 43.0, 0.04, 0.04, 12345 + 140 * n, 499 + 3 * n, "A", "F") for n in (1, 2)]
    spark.createDataFrame(twice, line).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = mesh_queries.refine_index(spark, str(tmp_path)).first()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    ((*wanted,),) = con.execute(mesh_queries.ORACLES["refine_index"]).fetchall()
    assert list(found) == wanted
    assert found["n_edges"] == 6 + 2 * 3


def test_loose_triangles_are_dealt_by_mesh_once(spark):
    rows = [(m, t, *[float(10 * t + v) for v in (0, 0, 0, 3, 0, 0, 0, 6, 0)]) for m in range(3) for t in range(4)]
    loose = spark.createDataFrame(rows, "mesh_id long, tri_id int, " + ", ".join(f"{c}{i} double" for i in range(3) for c in "xyz"))
    out = meshes.with_geometry(meshes.refined(meshes.with_pieces(loose), 4.0)).groupBy("mesh_id", "piece").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area"))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted((r["mesh_id"], r["piece"], r["n"], round(r["area"], 6)) for r in out.collect()) == [(m, t, 4, 9.0) for m in range(3) for t in range(4)]


def random_meshes(n=400, seed=5):
    """Meshes of a few triangles with shared edges, repeated numbers, equal triangles and long edges."""
    rng = random.Random(seed)
    point = lambda: tuple(float(rng.randint(0, 3) * 3) for _ in range(3))
    rows = [(m, rng.randint(0, 4), "g", *itertools.chain(*rng.sample([point() for _ in range(4)], 3))) for m in range(n) for _ in range(rng.randint(1, 7))]
    return sorted(r for r in rows if np.linalg.norm(np.cross(np.subtract(r[6:9], r[3:6]), np.subtract(r[9:], r[3:6]))) > 0)


def test_meshes_are_dealt_once(spark, monkeypatch):
    """Of the steps only the list of large meshes is written, and triangles are dealt by mesh once."""
    steps, write = [], stage.written
    for module in (meshes, prefix):
        monkeypatch.setattr(module, "written", lambda df, name="step": steps.append(name) or write(df, name))
    line = "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string"
    with tempfile.TemporaryDirectory() as there:
        spark.createDataFrame([(m, n, 3.0 * m, 0.04, 0.04, 12345 + 7 * n, 499 + n, "A", "F") for m in range(30) for n in range(4)], line).write.parquet(f"{there}/lineitem.parquet")
        out = mesh_queries.refine_index(spark, there)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert len(out.collect()) == 30
    assert steps == ["large-meshes"] and plan.count("Exchange hashpartitioning") == 1


def test_spread_meshes_have_the_same_figures(spark, monkeypatch):
    mesh = spark.createDataFrame(random_meshes(60), CORNERS)
    rounded = lambda rows: sorted((r["mesh_id"], r["n_vertices"], r["n_faces"], r["n_edges"], r["n_borders"], round(r["area"], 6)) for r in rows.collect())
    alone = rounded(meshes.refined_figures(mesh, 2.0))
    assert alone == rounded(meshes.refined_figures(meshes.with_pieces(mesh), 2.0)) == rounded(meshes.index_figures(*meshes.refined_index(mesh, 2.0)))
    monkeypatch.setattr(meshes, "LARGE_MESH", 3)
    assert rounded(meshes.refined_figures(mesh, 2.0)) == alone
    assert rounded(meshes.index_figures(*meshes.refined_index(mesh, 2.0))) == alone


def figures_of(rows, size, longest=2.0):
    batch = pa.Table.from_pylist([dict(zip(("mesh_id", "tri_id", "grp", *refinement.CORNERS), r)) for r in rows]).combine_chunks().to_batches()[0]
    out = []
    for part in refinement.whole_meshes(batch.slice(a, size) for a in range(0, len(rows), size)):
        for at, mesh, found in refinement.refined(part, longest):
            of = refinement.figures(mesh, found)
            ids = part.column("mesh_id").to_numpy()[at + np.searchsorted(mesh, np.arange(mesh[-1] + 1))]
            out += zip(ids.tolist(), *(v.round(6).tolist() for v in of.values()))
    return out


def test_meshes_stay_whole_over_batches(monkeypatch):
    rows = random_meshes(80)
    whole = figures_of(rows, len(rows))
    monkeypatch.setattr(refinement, "ROWS", 7)
    monkeypatch.setattr(refinement, "FACES", 40)
    for size in (1, 3, 50):
        assert figures_of(rows, size) == whole
    assert [r[0] for r in whole] == sorted({r[0] for r in rows})


def test_limits_of_a_refined_mesh():
    one = (1, 2, "g", 0.0, 0.0, 0.0, 7.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    for longest, message in ((1e-6, "rounds"), (0.01, "triangles")):
        with pytest.raises(ValueError, match=message):
            figures_of([one], 1, longest)
    lone = [(1, i, "g", *[x + (10.0 * i if k % 3 == 2 else 0.0) for k, x in enumerate(one[3:])]) for i in range(3400)]
    with pytest.raises(ValueError, match="20400 vertices"):
        figures_of(lone, 3400, 4.0)
    strip = [(1, i, "g", float(i // 2), float(i % 2), 0.0, i // 2 + 1.0, float(i % 2), 0.0, i // 2 + (1.0 - i % 2), 1.0 - i % 2, 0.0) for i in range(25_000)]
    ((_, vertices, faces, edges, borders, area),) = figures_of(strip, 10_000, 4.0)
    assert (vertices, faces, edges, borders, area) == (25_002, 25_000, 50_001, 25_002, 12_500.0)
