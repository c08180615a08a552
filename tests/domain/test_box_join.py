"""Boxes against all pairs, and even tasks whatever the density."""

import random

import pytest
from pyspark.sql import functions as F

from calorix.operators import box_join, places


def tables(spark, n=4000):
    rng = random.Random(3)
    points = [(i, rng.uniform(-89, 89), rng.uniform(-180, 180)) if i % 3 == 0 else (i, 45.0 + rng.uniform(0, 0.05), 5.0 + rng.uniform(0, 0.05)) for i in range(n)]
    points += [(n, 45.02, 5.02)] * 30 + [(n + 1, None, 5.0), (n + 2, 90.0, 180.0), (n + 3, -90.0, -180.0)]
    sites = [(i, rng.uniform(-80, 80), rng.uniform(-170, 170)) for i in range(20)] + [(100 + i, 45.0 + i / 500, 5.0 + i / 500) for i in range(20)] + [(200, None, 1.0)]
    return spark.createDataFrame(sites, "site_id long, lat double, lon double"), spark.createDataFrame(points, "p long, lat double, lon double").repartition(5)


@pytest.mark.parametrize("wanted, finest", [(20_000, 23), (40, 23), (7, 11)])
@pytest.mark.parametrize("radius", [300.0, 150_000.0])
def test_pairs_equal_fixed_cells(spark, wanted, finest, radius):
    sites, points = tables(spark)
    key = lambda df: sorted((r["site_id"], r["p"], round(r["dist"], 6)) for r in df.select("site_id", "p", "dist").collect())
    found = key(box_join.in_boxes(sites, points, radius, wanted, finest))
    assert found == key(places.in_boxes(sites.where("lat is not null"), points, radius, 1.0)) and len(found) > 100


def test_leaves_split_what_is_dense(spark):
    _, points = tables(spark, 20_000)
    tree = box_join.leaves(points.where("lat is not null"), 500).where("leaf")
    rows = tree.collect()
    assert sum(r["n"] for r in rows) == 20_000 + 32 and max(r["n"] for r in rows) <= 500
    assert {r["level"] for r in rows} != {box_join.TOP}, "the town is split"
    per_leaf = box_join.placed(points.where("lat is not null"), box_join.leaves(points, 500)).groupBy("__level", "__cell").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(r["n"] for r in per_leaf.collect()) == sorted(r["n"] for r in rows)
    assert box_join.leaves(points.where("p < 0")).count() == 0


def test_nearest_where_places_repeat(spark):
    """One search for sites in one place, and of points in one place only the first ones: the same rows as over all pairs."""
    sites = spark.range(40).select(F.col("id").alias("site_id"), (F.col("id") % 4).cast("double").alias("lat"), (F.col("id") % 3).cast("double").alias("lon"))
    points = spark.range(3000).select(F.col("id").alias("cand_id"), (F.col("id") % 20 / 10.0).alias("lat"), (F.col("id") % 7 / 3.0).alias("lon"), F.when(F.col("id") % 11 > 0, F.col("id") % 6).alias("n_walls"))
    ok = F.col("n_walls") <= 1
    found = places.nearest_in_boxes(sites, points, 110_000.0, ok, 5, "cand_id")
    every = places.nearest_accepted(places.in_boxes(sites, points, 110_000.0), ok, 5, ("site_id",), ("dist", "cand_id"))
    columns = sorted(every.columns)
    assert sorted(found.columns) == columns
    rows = sorted(map(tuple, found.select(columns).collect()))
    assert rows == sorted(map(tuple, every.select(columns).collect())) and len(rows) > 100
    assert any(r["skipped"] > 5 for r in found.collect())
