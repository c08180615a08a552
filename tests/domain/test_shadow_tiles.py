"""Rays over tiles against every pair and against a packed scene."""

import random
import tempfile

import numpy as np
import pytest

from calorix.operators import packed_scene, prefix, shadow_tiles
from calorix.operators.refinement import CORNERS
from calorix.plans import sight_queries
from calorix.sources import stage

TOWARDS = [(0.5, 0.6, 0.62), (-0.7, 0.1, 0.7), (0.0, 0.0, 1.0)]


def scene(n=800, seed=4):
    """Small triangles over a plain, some of them large, high, or without area; objects of several triangles, one without a name."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = 40.0 if i % 60 == 0 else 5.0
        p = [rng.uniform(0, 600), rng.uniform(0, 60), rng.uniform(0, 8) + (10 if i % 70 == 1 else 0)]
        rows.append((i // 4 if i // 4 else None, *[x + rng.uniform(-size, size) * (0.1 if c == 2 else 1) for _ in range(3) for c, x in enumerate(p)]))
    return [*rows, (5, *[1.0] * 9), (6, 1.0, 1.0, 1.0, 2.0, 2.0, 1.0, 3.0, 3.0, 1.0)]


def brute(rows, least=1e-3):
    out = {}
    corners = np.array([r[1:] for r in rows]).reshape(-1, 3, 3)
    for row, (a, b, c) in zip(rows, corners):
        n = np.cross(b - a, c - a)
        if np.linalg.norm(n) < 1e-12:
            continue
        n, e1, e2 = n / np.linalg.norm(n), corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0]
        o = (a + b + c) / 3 + 1e-3 * n
        for d in map(np.array, TOWARDS):
            if n @ d <= least:
                continue
            t, p = o - corners[:, 0], np.cross(d, e2)
            det, q = (e1 * p).sum(1), np.cross(t, e1)
            with np.errstate(divide="ignore", invalid="ignore"):
                u, v, w = (t * p).sum(1) / det, (q @ d) / det, (e2 * q).sum(1) / det
            met = w[(np.abs(det) > 1e-12) & (u >= 0) & (v >= 0) & (u + v <= 1) & (w > 1e-9)]
            rays = out.setdefault(row[0], [])
            rays.append(met.min() if len(met) else None)
    hit = {k: [x for x in v if x is not None] for k, v in out.items()}
    return {k: (len(v), len(hit[k]), round(sum(hit[k]) / len(hit[k]), 6) if hit[k] else None) for k, v in out.items()}


@pytest.mark.parametrize("tile, largest", [(20_000, 300_000), (20, 300_000), (20, 1)])
def test_occlusion_equals_every_pair(spark, monkeypatch, tile, largest):
    """In one tile, in many, and in a packed scene as tiles would be too full."""
    for name, value in (("TILE", tile), ("LARGEST", largest), ("COPIES", 50.0)):
        monkeypatch.setattr(shadow_tiles, name, value)
    rows = scene()
    triangles = spark.createDataFrame(rows, "mesh_id long, " + ", ".join(f"{c} double" for c in CORNERS))
    dealt = shadow_tiles._dealt(triangles, TOWARDS)
    assert (dealt is None) == (largest == 1)
    if dealt is not None:
        assert dealt.where("home").count() == len(rows) and (dealt.select("tile").distinct().count() > 3) == (tile == 20)
    found = {r["mesh_id"]: (r["n_rays"], r["n_blocked"], r["mean_distance"] and round(r["mean_distance"], 6)) for r in shadow_tiles.occlusion(triangles, TOWARDS, 1e-3).collect()}
    want = brute(rows)
    assert found == want and sum(w[1] for w in want.values()) > 50 and None in found


def test_candidates_in_parts(monkeypatch):
    corners = np.array([r[1:] for r in scene()]).reshape(-1, 3, 3)
    origins = corners.mean(axis=1)
    together = [np.concatenate(x) for x in zip(*shadow_tiles._candidates(corners, origins, np.array(TOWARDS[0])))]
    monkeypatch.setattr(shadow_tiles, "PAIRS", 30)
    parts = list(shadow_tiles._candidates(corners, origins, np.array(TOWARDS[0])))
    assert len(parts) > 20 and sorted(zip(*(np.concatenate(x).tolist() for x in zip(*parts)))) == sorted(zip(*(x.tolist() for x in together)))


def test_without_rays(spark):
    none = spark.createDataFrame([], "mesh_id long, " + ", ".join(f"{c} double" for c in CORNERS))
    assert shadow_tiles.occlusion(none, TOWARDS).collect() == []


def test_triangles_are_dealt_once(spark, monkeypatch):
    """No step is written, and only the figures are dealt after the triangles."""
    steps, write = [], stage.written
    for module in (sight_queries, packed_scene, prefix):
        monkeypatch.setattr(module, "written", lambda df, name="step": steps.append(name) or write(df, name))
    line = "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string"
    with tempfile.TemporaryDirectory() as there:
        spark.createDataFrame([(m, n, 3.0 * n, 0.04, 0.04, 12345 + 7 * n, 499 + n, "A", "F") for m in range(300) for n in range(4)], line).write.parquet(f"{there}/lineitem.parquet")
        out = sight_queries.city_occlusion(spark, there)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert len(out.collect()) == 300
    assert steps == [] and plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan
