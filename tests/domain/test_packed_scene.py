"""Packed scenes against every pair."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from calorix.operators.packed_scene import CORNERS, PackedScene, curve_place


def brute(rays, triangles):
    out = set()
    for r in rays:
        o, d = np.array(r[1:4]), np.array(r[4:7])
        for t in triangles:
            a, b, c = (np.array(t[2 + 3 * i : 5 + 3 * i]) for i in range(3))
            e1, e2 = b - a, c - a
            p, q = np.cross(d, e2), np.cross(o - a, e1)
            det = e1 @ p
            if abs(det) > 1e-12 and ((o - a) @ p) / det >= 0 and (d @ q) / det >= 0 and ((o - a) @ p + d @ q) / det <= 1 and (e2 @ q) / det > 1e-9:
                out.add((r[0], t[0], round(float(e2 @ q / det), 6)))
    return out


@pytest.mark.parametrize("width", [2, 32])
def test_hits_equal_every_pair(spark, width):
    rng = random.Random(2)
    triangles = []
    for i in range(300):
        p = [rng.uniform(-50, 50) for _ in range(3)]
        triangles.append((i, None if i % 4 else 0.5, *[x + rng.uniform(-6, 6) for _ in range(3) for x in p]))
    triangles.append((300, None, -500.0, -500.0, 60.0, 500.0, -500.0, 60.0, 0.0, 800.0, 60.0))
    rays = [(i, *[rng.uniform(-60, 60) for _ in range(3)], *[rng.gauss(0, 1) for _ in range(3)]) for i in range(80)]
    rays += [(100, 1.0, 2.0, 3.0, 0.0, 0.0, 1.0), (101, 1.0, 2.0, 3.0, 1.0, 0.0, 0.0), (102, 1.0, 2.0, 3.0, 0.0, -1.0, 0.0)]
    scene = PackedScene(spark.createDataFrame(triangles, "obj long, k double, " + ", ".join(f"{c} double" for c in CORNERS)), width)
    found = scene.hits(spark.createDataFrame(rays, "ray long, ox double, oy double, oz double, sx double, sy double, sz double"), ("ray",))
    want = brute(rays, triangles)
    assert {(r["ray"], r["obj"], round(r["distance"], 6)) for r in found.collect()} == want and len(want) > 40


def test_places_on_the_curve(spark):
    df = spark.createDataFrame([(float(x), float(y), float(z)) for x in range(4) for y in range(4) for z in range(4)], "x double, y double, z double")
    places = [r[0] for r in df.select(curve_place((F.col("x") / 4, F.col("y") / 4, F.col("z") / 4), (0.0, 0.0, 0.0), 1.0)).collect()]
    interleaved = [sum(((v >> b & 1) << (3 * b + axis)) for axis, v in enumerate((x, y, z)) for b in range(2)) for x in range(4) for y in range(4) for z in range(4)]
    assert [p >> 42 for p in places] == interleaved
