"""Polygon operations against a fine raster, and scenes composed of them."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from calorix.operators import polygons, scenes

SQUARE = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
L_FORM = [(0.0, 0.0), (6.0, 0.0), (6.0, 2.0), (2.0, 2.0), (2.0, 6.0), (0.0, 6.0)]


def star(rng, cx, cy, n):
    at = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(cx + rng.uniform(1, 6) * math.cos(a), cy + rng.uniform(1, 6) * math.sin(a)) for a in at]


def raster(shape, x, y):
    hit = np.zeros(x.shape, bool)
    for ring in shape:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
            if y0 != y1:
                hit ^= ((y0 <= y) != (y1 <= y)) & (x < x0 + (y - y0) * (x1 - x0) / (y1 - y0))
    return hit


@pytest.mark.parametrize("seed", range(12))
def test_operations_equal_a_raster(seed):
    rng = random.Random(seed)
    a, b = [star(rng, 0, 0, 9)], [star(rng, 2, 1, 8), star(rng, 1, 1, 5)]
    if seed % 2:
        a = [a[0][::-1]]
    x, y = np.meshgrid(np.linspace(-8, 10, 900), np.linspace(-8, 10, 900))
    cell = (18 / 899) ** 2
    ia, ib = raster(a, x, y), raster(b, x, y)
    for keep, expected in ((all, ia & ib), (any, ia | ib), (lambda i: i[0] and not i[1], ia & ~ib)):
        traps = polygons.sweep([a, b], keep)
        assert polygons.area_of(traps) == pytest.approx(expected.sum() * cell, abs=0.25)
        rings = polygons.rings_of(traps)
        assert sum(map(polygons.signed_area, rings)) == pytest.approx(polygons.area_of(traps), abs=1e-6)
        assert (raster(rings, x, y) != expected).mean() < 0.004
        assert sum(map(polygons.part_area, polygons.parts_of(rings))) == pytest.approx(polygons.area_of(traps), abs=1e-6)


def test_statuses_against_concave_and_holed_study():
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    assert polygons.against(box(3.0, 3.0, 2.0, 2.0), [L_FORM])["status"] == "kept"  # in the L's notch
    assert polygons.against(box(-2.0, 0.0, 2.0, 3.0), [L_FORM])["status"] == "kept"  # a shared wall
    clipped = polygons.against(box(0.0, 0.0, 20.0, 20.0), [L_FORM])
    assert clipped["status"] == "clipped" and clipped["overlap"] == pytest.approx(20) and sum(map(polygons.part_area, clipped["parts"])) == pytest.approx(380)
    assert polygons.against(SQUARE, [SQUARE[::-1]])["status"] == "self"
    assert polygons.against(box(1.0, 1.0, 1.0, 1.0), [SQUARE])["status"] == "self"  # nothing is left
    holed = [SQUARE, box(3.0, 3.0, 4.0, 4.0)]
    assert polygons.against(box(4.0, 4.0, 1.0, 1.0), holed)["status"] == "kept"
    assert polygons.against([(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)], [SQUARE])["status"] == "degenerate"
    assert polygons.against(SQUARE, None)["status"] == "kept"
    split = polygons.against(box(-5.0, 4.0, 30.0, 2.0), [SQUARE])
    assert split["status"] == "clipped" and sorted(round(polygons.part_area(p)) for p in split["parts"]) == [10, 30]


def test_repair_and_dissolve():
    bow_tie = [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 2.0)]
    assert polygons.part_area(polygons.repaired([bow_tie])) > 1
    cells = [[[(x, y), (x + 1.0, y), (x + 1.0, y + 1.0)]] for x in range(6) for y in range(6)] + [[[(x + 1.0, y + 1.0), (x, y + 1.0), (x, y)]] for x in range(6) for y in range(6)]
    flat = polygons.dissolved([[[(float(a), float(b)) for a, b in s[0]]] for s in cells])
    assert len(flat) == 1 and len(flat[0]) == 4 and polygons.signed_area(flat[0]) == pytest.approx(36)


def test_prisms_with_holes_are_closed():
    hole = [(3.0, 3.0), (3.0, 7.0), (7.0, 7.0), (7.0, 3.0)]
    faces = polygons.prism([[SQUARE, hole]], 5.0, 1.0)
    corners = np.array([[[f[f"{c}{i}"] for c in "xyz"] for i in range(3)] for f in faces])
    volume = np.einsum("ij,ij->i", corners[:, 0], np.cross(corners[:, 1], corners[:, 2])).sum() / 6
    assert volume == pytest.approx((100 - 16) * 5)
    assert len({f["grp"] for f in faces}) == 2 + 8


def degrees(x, y, site):
    r = 6_378_137.0
    return site.lat + math.degrees(y / r), site.lon + math.degrees(x / (r * math.cos(math.radians(site.lat))))


def ring_at(x, y, w, h, site):
    return [dict(zip(("lat", "lon"), degrees(a, b, site))) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]


def test_environment_composes(spark):
    site = scenes.Site(48.0, 2.0, 0.0, 100.0, [L_FORM])
    rows = [(0, ring_at(0, 0, 6, 6, site), 9.0, False, "ign", 103.0), (1, ring_at(30, 0, 8, 8, site), 0.5, True, "osm", None), (2, ring_at(5, -10, 4, 20, site), 6.0, False, "ign", None), (3, ring_at(90, 0, 5, 5, site), 6.0, True, "osm", None)]
    items = spark.createDataFrame(rows, "item long, ring array<struct<lat:double,lon:double>>, height double, approx boolean, source string, base_z double")
    lookup = spark.createDataFrame([(1, 104.0)], "item long, altitude double")
    triangles, stats = scenes.environment(items, site, lookup)
    s = stats.first()
    assert (s["n_total"], s["n_used"], s["n_self"], s["n_clipped"], s["n_skipped"], s["n_ign"], s["n_osm"], s["n_approx"]) == (4, 3, 1, 1, 0, 2, 2, 2)
    found = triangles.toPandas()
    assert sorted(found["tri_id"]) == list(range(len(found)))
    of = found[found["item"] == 1]
    assert of["z0"].min() == pytest.approx(4) and of[["z0", "z1", "z2"]].max().max() == pytest.approx(5)  # at least 1 m high
    assert len(of) == 12 and found[found["item"] == 3]["z0"].min() == 0


def test_vegetation_composes(spark):
    site = scenes.Site(48.0, 2.0, 0.0, 0.0, [SQUARE])
    zone = "item long, ring array<struct<lat:double,lon:double>>, height double, k double"
    zones = spark.createDataFrame([(0, ring_at(-50, -50, 100, 100, site), 15.0, 0.15)], zone)
    abroad = spark.createDataFrame([(1, ring_at(200, 0, 9, 9, site), 15.0, 0.2)], zone)
    lat, lon = degrees(40.0, 0.0, site)
    trees = spark.createDataFrame([(2, lat, lon, 3.0, 12.0, 0.2)], "item long, lat double, lon double, radius double, height double, k double")
    triangles, stats = scenes.vegetation(zones, trees, abroad, site)
    assert tuple(stats.first()) == (2, 2, 0)
    found = triangles.toPandas()
    assert set(found["obj"]) == {0, 1} and set(found[found["item"] == 2]["k"]) == {0.2}
    assert len(found[found["item"] == 2]["grp"].unique()) == 10


def test_study_polygons_and_nearby(spark):
    rows = [(1, 0.0, 0.0, 0.0, 4.0, 0.0, 0.0, 4.0, 3.0, 0.0), (1, 0.0, 0.0, 0.0, 4.0, 3.0, 0.0, 0.0, 3.0, 0.0), (1, 0.0, 0.0, 0.0, 4.0, 0.0, 0.0, 4.0, 0.0, 5.0), (2, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 3.0)]
    mesh = spark.createDataFrame(rows, "building_id long, " + ", ".join(f"{c}{i} double" for i in range(3) for c in "xyz"))
    found = {r["building_id"]: r["study"] for r in polygons.study_polygons(mesh).collect()}
    assert len(found[1]) == 1 and len(found[1][0]) == 4 and found[2] == []
    buildings = spark.range(8).selectExpr("id as cand_id", "48D + id / 10000 as lat", "2D as lon", "transform(sequence(0, if(id = 0, 40, 3)), i -> named_struct('x', 9 * cos(i * 2 * pi() / if(id = 0, 41, 4)), 'y', 9 * sin(i * 2 * pi() / if(id = 0, 41, 4)))) as ring", "6D as height")
    sites = spark.createDataFrame([(7, 48.0, 2.0)], "site_id long, lat double, lon double")
    near = scenes.nearby(sites, buildings, 2000.0, k=3).orderBy("rank").collect()
    assert [r["cand_id"] for r in near] == [1, 2, 3] and {r["skipped"] for r in near} == {1} and all(len(r["faces"]) == 12 for r in near)


def test_terrain_is_level_under_the_study(spark):
    site = scenes.Site(48.0, 2.0, 0.0, 50.0, [SQUARE])
    places = scenes.grid_places(spark, site, 20.0, 5.0)
    altitudes = places.select("vid", (F.col("vid") + 51.0).alias("altitude"))
    grid, faces = scenes.terrain(spark, site, altitudes, 20.0, 5.0)
    z = {(r["x"], r["y"]): (r["vid"], r["z"]) for r in grid.collect()}
    assert z[5.0, 5.0][1] == 0 and z[-20.0, -20.0] == (0, 1.0) and faces.count() == 128
    with pytest.raises(ValueError, match="altitude"):
        scenes.terrain(spark, site, altitudes.where("vid > 3"), 20.0, 5.0)
