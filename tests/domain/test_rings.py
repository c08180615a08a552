"""Points in many rings against a loop."""

import random

from pyspark.sql import functions as F

from calorix.operators import rings


def crossings(x, y, ring):
    odd = False
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
        if y0 != y1 and min(y0, y1) <= y < max(y0, y1) and x < x0 + (y - y0) * ((x1 - x0) / (y1 - y0)):
            odd = not odd
    return odd


def test_inside_equals_a_loop(spark):
    rng = random.Random(4)
    plans = {g: [[(rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(rng.randint(3, 12))] for _ in range(1 + g % 2)] for g in range(6)}
    plans[0] = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]]
    plans[7] = [[(0.0, 0.0), (1000.0, 500.0), (0.0, 1000.0)]]
    plans[8] = [[(0.0, 0.0), (1.0, 1.0)], []]
    points = [(g, float(x), float(y)) for g in range(10) for x in range(-9, 10, 3) for y in range(-9, 10, 2)] + [(7, 300.0, 480.5), (7, -1.0, 5.0), (0, 2.0, 2.0), (0, 0.5, 2.0), (0, None, 2.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame([(g, [{"x": x, "y": y} for x, y in r]) for g, rs in plans.items() for r in rs], "g long, ring array<struct<x double, y double>>")
    found = rings.with_inside(spark.createDataFrame(points, "g long, x double, y double"), df, ("g",)).collect()
    assert len(found) == len(points)
    for r in found:
        want = r["g"] is not None and r["x"] is not None and sum(crossings(r["x"], r["y"], ring) for ring in plans.get(r["g"], []) if len(ring) > 2) % 2 == 1
        assert r["inside"] == want, r
    assert any(r["inside"] for r in found if r["g"] == 7) and not any(r["inside"] for r in found if r["g"] in (8, 9))
    assert rings.with_inside(spark.createDataFrame(points[:5], "g long, x double, y double"), df.where("g > 99"), ("g",)).where("inside").count() == 0


def test_rings_in_the_row_equal_a_loop(spark):
    """Each row's own ring, by the same rule, without a shuffle of the points."""
    rng = random.Random(5)
    plans = [[(rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(rng.randint(3, 9))] for _ in range(6)] + [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)], [(0.0, 0.0), (1.0, 1.0)], [], None]
    sites = spark.createDataFrame([(g, r and [{"x": x, "y": y} for x, y in r]) for g, r in enumerate(plans)], "g long, ring array<struct<x double, y double>>")
    found = rings.grid_heights(sites, 9.0, 3.0, F.col("x") + 7.0, F.lit(5.0))
    rows = found.collect()
    assert len(rows) == 49 * len(plans)
    for r in rows:
        ring = plans[r["g"]] or []
        want = len(ring) > 2 and crossings(r["x"], r["y"], ring)
        assert (r["inside"], r["z"]) == (want, 0.0 if want else r["x"] + 2.0), r
    assert any(r["inside"] for r in rows) and "Join" not in found._jdf.queryExecution().executedPlan().toString()
