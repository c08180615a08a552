"""Footprints against known counts and areas; checks before a run."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from calorix.functions import display
from calorix.operators import constraints, footprints, meshes, polygons

RING = f"id int, ring array<{footprints.POINT}>, height double, base double"
STUDY = [(0.0, 0.0), (8.0, 0.0), (8.0, 6.0), (0.0, 6.0)]


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def test_extrusion_counts_areas_and_directions(spark):
    ell = [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 3.0), (0.0, 3.0)]
    rows = [(1, box(0.0, 0.0, 4.0, 3.0), 5.0, 2.0), (2, ell[::-1] + ell[-1:], 0.2, 0.0), (3, [(0.0, 0.0), (1.0, 1.0)], 3.0, 0.0), (4, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)], 3.0, 0.0)]
    out = meshes.with_geometry(footprints.extruded(spark.createDataFrame(rows, RING))).toPandas()
    assert out.groupby("id").size().to_dict() == {1: 12, 2: 20}
    area = out.groupby(["id", out["grp"].str[:3]])["area"].sum()
    assert area[1, "sol"] == area[1, "toi"] == pytest.approx(12) and area[1, "mur"] == pytest.approx(70)
    assert area[2, "sol"] == pytest.approx(6) and area[2, "mur"] == pytest.approx(14)
    assert (out[out["grp"] == "toit"]["nz"] > 0.99).all() and (out[out["grp"] == "sol"]["nz"] < -0.99).all()
    assert out[out["id"] == 1]["z0"].min() == 2.0


@pytest.mark.parametrize(
    ("ring", "status", "left"),
    [
        (box(0.0, 0.0, 8.0, 6.0), "self", 0), (box(8.0, 0.0, 8.0, 6.0), "kept", 48), (box(7.0, 0.0, 8.0, 6.0), "clipped", 42), (box(-8.0, -7.0, 25.0, 20.0), "clipped", 452),
        (box(-2.0, 2.0, 12.0, 1.0), "clipped", 4), (box(-0.05, 0.0, 0.5, 6.0), "self", 0.3), (box(1.0, 1.0, 0.0, 2.0), "degenerate", 0),
    ],
)
def test_overlap_statuses(spark, ring, status, left):
    row = footprints.overlaps(spark.createDataFrame([(1, ring, 3.0, 0.0)], RING), STUDY).first()
    assert row["status"] == status and row["left"] == pytest.approx(left, abs=1e-9)
    assert footprints.overlaps(spark.createDataFrame([(1, ring, 3.0, 0.0)], RING), []).first()["status"] == "kept"


def test_crown_is_a_regular_octagon(spark):
    row = spark.range(1).select(footprints.crown(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("ring")).select(F.size("ring").alias("n"), footprints.signed_area(F.col("ring")).alias("a")).first()
    assert row["n"] == 8 and row["a"] == pytest.approx(2 * 2**0.5 * 9)


def test_checks(spark):
    rows = spark.createDataFrame([(0, 1.0, 3.0), (1, None, 4.0), (2, 99.0, 5.0)], "seq int, t_ext double, wind_m_s double")
    assert rows.where(constraints.within({"t_ext": (-60.0, 60.0)})).count() == 1
    assert tuple(constraints.all_have(rows, "t_ext").first()) == (1, 1)
    faces = spark.createDataFrame([(0, 1, 2), (0, 1, 3), (-1, 0, 1), (None, 0, 1)], "v0 int, v1 int, v2 int")
    assert constraints.bad_corners(faces, 3).count() == 3
    assert constraints.work(spark.sql("select 9000 hours, 5 rays")).first()["over"] == "hours"
    with pytest.raises(Exception):
        constraints.enforced(rows, F.col("t_ext") < 50, "too warm").count()
    jobs = spark.createDataFrame([("sim", "DONE"), ("fetch", "RUNNING")], "kind string, status string")
    assert constraints.free_of_jobs(jobs, "sim").first()["free"] and not constraints.free_of_jobs(jobs).first()["free"]
    a, b = (constraints.content_version(faces.coalesce(n).withColumn("m", F.lit(1)), "m", ["v0", "v1", "v2"]).first()["version"] for n in (1, 2))
    assert a == b


def test_display_values(spark):
    r = spark.range(1).select(
        *display.hour_parts(F.lit(-1), F.lit(0)), display.air_flow(F.lit(10.0), F.lit(0.125)), display.per_area(F.lit(4.0), F.lit(0.0)), display.ramp(F.lit(5.0), F.lit(0.0), F.lit(10.0), "#000000", "#ff8000"), display.ticks(F.lit(0.0), F.lit(1.0), 4)
    ).first()
    assert list(r)[:3] == [-1, 6, 23] and r[3] == 1.3 and r[4] is None and r[5] == "#804000" and r[6] == [0, 0.25, 0.5, 0.75, 1]
    departments, users = display.sample_entities(spark)
    assert departments.count() == users.count() == 3


def test_convex_rings_are_resolved_together():
    """Convex rings off the study polygon's box have what a sweep gives, without one; all others are left to the sweep."""
    draw, rings = np.random.default_rng(3), []
    for k in range(200):
        angles, far = np.sort(draw.uniform(0, 2 * np.pi, 3 + k % 6)), 5.0 + k % 7
        ring = [(float(far * np.cos(a)) + 40.0 * k, float(far * np.sin(a))) for a in angles]
        rings.append(ring[::-1] if k % 3 == 0 else [*ring, ring[0]] if k % 3 == 1 else ring)
    box = [(0.0, 100.0), (4.0, 100.0), (4.0, 103.0), (0.0, 103.0)]
    star = [(float(np.cos(a)), float(np.sin(a)) + 200.0) for a in np.arange(5) * 4 * np.pi / 5]
    dented, flat = [(0.0, 300.0), (4.0, 300.0), (1.0, 301.0), (0.0, 304.0)], [(0.0, 400.0), (2.0, 400.0), (4.0, 400.0), (4.0, 403.0)]
    line, near = [(0.0, 500.0), (1.0, 500.0)], [(-500.0, 0.0), (-499.0, 0.0), (-499.0, 1.0)]
    rings += [box, star, dented, flat, line, near, None, []]
    column = pa.array([None if r is None else [{"x": x, "y": y} for x, y in r] for r in rings], polygons.POINTS)
    found = {}
    for rows, areas, parts in polygons.convex_apart(column, (-510.0, -10.0, -490.0, 10.0)):
        found |= dict(zip(rows.tolist(), zip(areas.tolist(), parts.to_pylist())))
    assert 200 in found and len(found) > 190 and not found.keys() & set(range(201, 208))
    for i, (area, parts) in found.items():
        wanted = polygons.against(polygons.points(column[i].as_py()), None)
        assert area == pytest.approx(wanted["area"], abs=1e-9)
        ((got,),), ((ring,),) = ([[polygons.points(r) for r in p] for p in parts], wanted["parts"])
        assert np.allclose(got, ring, atol=1e-6), "the same corners from the same start"


def test_only_large_meshes_are_welded_over_tasks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(m, s, *map(float, rng.integers(0, 2, 3))) for m, n in ((1, 12), (2, 3), (3, 30), (4, 1)) for s in range(n)]
    corners = spark.createDataFrame(rows, "mesh_id long, seq int, x double, y double, z double").repartition(3)
    want, seen = {}, {}
    for m, s, *at in rows:
        of = seen.setdefault(m, {})
        want[m, s] = of.setdefault(tuple(at), len(of))
    found = lambda: {(r["mesh_id"], r["seq"]): r["vertex"] for r in meshes.welded(corners, "mesh_id", "seq").collect()}
    calls, running = [], meshes.running
    monkeypatch.setattr(meshes, "running", lambda *a, **k: calls.append(1) or running(*a, **k))
    assert found() == want and not calls, "small meshes are dealt by mesh alone"
    monkeypatch.setattr(meshes, "LARGE", 10)
    assert found() == want and calls
