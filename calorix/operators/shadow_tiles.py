"""Rays of a scene's own triangles towards a few directions above the horizon: how many are blocked, and how far off.

The ground is cut into tiles.  A ray belongs to the tile that its origin is in, and a
triangle to all tiles with origins whose rays can meet it: those under it and, as
far as it rises above the lowest origin, those behind its shadow.  So triangles are dealt
once, with a few copies along the tiles' borders, and neither rays nor boxes are dealt at
all.  In a tile the scene is seen along each direction: rays are points, and triangles
meet the points in their cells, whose size is their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calorix.functions import geometry
from calorix.operators import meshes, packed_scene, visibility
from calorix.operators.refinement import CORNERS, whole_groups
from calorix.sources.stage import written

#: Triangles that a tile has on average, and most of one; rows dealt for a triangle at most on average, or the scene is packed instead.
TILE, LARGEST, COPIES = 20_000, 300_000, 2.0
#: Pairs of a ray and a triangle that are tested at once; slack of the cells in metres.
PAIRS, SLACK = 1 << 19, 1e-6
Direction = tuple[float, float, float]


def occlusion(triangles: DataFrame, directions: list[Direction], least: float = visibility.CULL, by: str = "mesh_id") -> DataFrame:
    """by, n_rays, n_blocked and mean_distance (to the first triangle met, null without one) of the rays from all triangles' centroids.

    triangles: by, corners; those without area are no use.  directions: a few, above the horizon;
    a triangle has a ray where its normal's cosine to the direction is over ``least``.
    """
    kept = triangles.select(by, *CORNERS)
    placed = _dealt(kept, directions)
    if placed is None:
        return _packed(triangles, directions, least, by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "tile", 1):
            tiles = rows.column("tile").to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(tiles)) + 1).tolist(), len(tiles)]
            for a, b in zip(starts, starts[1:]):
                yield _tile(rows.slice(a, b - a), directions, least, by)

    schema = f"`{by}` {kept.schema[by].dataType.simpleString()}, n_rays long, n_blocked long, total double"
    found = placed.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, schema).groupBy(by).agg(*[F.sum(c).alias(c) for c in ("n_rays", "n_blocked", "total")])
    return found.select(by, "n_rays", "n_blocked", F.when(F.col("n_blocked") > 0, F.col("total") / F.col("n_blocked")).alias("mean_distance"))


def _packed(triangles: DataFrame, directions: list[Direction], least: float, by: str) -> DataFrame:
    """The same by a packed scene: for scenes that are high or crowded for their size."""
    suns = triangles.sparkSession.createDataFrame([(i, *d) for i, d in enumerate(directions)], "sun int, sx double, sy double, sz double")
    faces = written(visibility.with_origins(meshes.with_geometry(triangles.select(by, *CORNERS)).where("not degenerate")), "city")
    surfaces = faces.withColumn("src", F.monotonically_increasing_id()).select("src", by, "ox", "oy", "oz", "nx", "ny", "nz")
    rays = written(visibility.facing(surfaces, suns, least), "rays")
    scene = packed_scene.PackedScene(faces.select(*CORNERS, F.lit(0).alias("obj"), F.lit(None).cast("double").alias("k")))
    first = scene.hits(rays, ("src", "sun")).groupBy("src", "sun").agg(F.min("distance").alias("first"))
    return rays.join(first, ["src", "sun"], "left").groupBy(by).agg(F.count(F.lit(1)).alias("n_rays"), F.count("first").alias("n_blocked"), F.avg("first").alias("mean_distance"))


def _dealt(kept: DataFrame, directions: list[Direction]) -> DataFrame | None:
    """Triangles with each ``tile`` that they belong to, and whether the ray starts there (``home``); None where tiles would be too full or copies too many."""
    if min(d[2] for d in directions) <= 0:
        return None
    ends = {c: [F.col(f"{c}{i}") for i in range(3)] for c in "xyz"}
    low, high = ({c: f(*ends[c]) for c in "xyz"} for f in (F.least, F.greatest))
    whole = kept.agg(F.count(F.lit(1)).alias("n"), *[F.min(low[c]).alias(f"lo_{c}") for c in "xyz"], *[F.max(high[c]).alias(f"hi_{c}") for c in "xyz"]).first()
    if not whole["n"]:
        return kept.select("*", F.lit(0).cast("long").alias("tile"), F.lit(True).alias("home"))
    spans, lift = {c: whole[f"hi_{c}"] - whole[f"lo_{c}"] for c in "xyz"}, visibility.LIFT
    share = TILE / whole["n"]
    reach = [[d[i] / d[2] for d in directions] for i in range(2)]  # metres towards the direction for each metre of height
    halo = (spans["z"] + 2 * lift) * max(abs(r) for rs in reach for r in rs)
    side = max((spans["x"] * spans["y"] * share) ** 0.5, max(spans["x"], spans["y"]) * share, 4 * halo, 1e-3)
    rise = high["z"] - (whole["lo_z"] - lift) + SLACK  # above the lowest origin
    tiles = []
    for c, rs in zip("xy", reach):
        last = int(spans[c] // side)
        cell = lambda at, c=c, last=last: F.least(F.greatest(F.floor((at - whole[f"lo_{c}"]) / side), F.lit(0)), F.lit(last)).cast("long")
        middle = (ends[c][0] + ends[c][1] + ends[c][2]) / 3.0
        # The origin is at most the lift from the centroid; its tile is that of the centroid, so that what it may meet is sought as far off.
        a, b = (f(F.lit(0.0), *[rise * -r for r in rs]) for f in (F.least, F.greatest))
        tiles.append((cell(low[c] + a - lift - SLACK), cell(high[c] + b + lift + SLACK), cell(middle)))
    (i0, i1, i), (j0, j1, j) = tiles
    named = lambda i, j: F.shiftleft(i, 32).bitwiseOR(j)
    out = kept.withColumns({"__home": named(i, j), "__j0": j0, "__j1": j1}).withColumn("__i", F.explode(F.sequence(i0, i1)))
    out = out.withColumn("__j", F.explode(F.sequence("__j0", "__j1"))).withColumn("tile", named(F.col("__i"), F.col("__j")))
    out = out.select(*kept.columns, "tile", (F.col("tile") == F.col("__home")).alias("home"))
    rows, most = out.groupBy("tile").count().agg(F.sum("count"), F.max("count")).first()
    return out if most <= LARGEST and rows <= COPIES * whole["n"] else None


def _tile(rows: pa.RecordBatch, directions: list[Direction], least: float, by: str) -> pa.RecordBatch:
    """The counts of the rays that start in a tile."""
    corners = np.stack([rows.column(c).to_numpy(zero_copy_only=False) for c in CORNERS], 1).reshape(-1, 3, 3)
    home = np.flatnonzero(rows.column("home").to_numpy(zero_copy_only=False))
    a, e1, e2 = corners[:, 0], corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0]
    n = np.cross(e1, e2)
    squared = (n * n).sum(axis=1)
    squared[np.sqrt(squared) < geometry.DEGENERATE] = np.nan  # compares as false: neither a ray nor met
    unit = n[home] / np.sqrt(squared[home])[:, None]
    origin = corners[home].sum(axis=1) / 3.0 + visibility.LIFT * unit
    # A triangle's plane and the shares of its corners in a point of it, as in ``packed_scene.planes``.
    u, v = np.cross(e2, n) / squared[:, None], np.cross(n, e1) / squared[:, None]
    w = -(u + v)
    dot = lambda p, q: (p * q).sum(axis=-1)
    plane = [(n, dot(n, a)), (u, -dot(u, a)), (v, -dot(v, a)), (w, 1.0 - dot(w, a))]
    mesh = rows.column(by).dictionary_encode()
    of = mesh.indices.fill_null(len(mesh.dictionary)).to_numpy()[home]
    sums = np.zeros((3, len(mesh.dictionary) + 1))
    for d in directions:
        s = np.array(d)
        facing = np.flatnonzero(dot(unit, s) > least)
        first, o = np.full(len(facing), np.inf), origin[facing]
        for t, r in _candidates(corners, o, s):
            towards = dot(plane[0][0][t], s)
            with np.errstate(divide="ignore", invalid="ignore"):
                distance = (plane[0][1][t] - dot(plane[0][0][t], o[r])) / towards
            inside = (np.abs(towards) > packed_scene.FLAT) & (distance > packed_scene.NEAR)
            for x, at in plane[1:]:
                inside &= dot(x[t], o[r]) + at[t] + distance * dot(x[t], s) >= 0
            np.minimum.at(first, r[inside], distance[inside])
        met = np.isfinite(first)
        for k, weights in enumerate((None, met, np.where(met, first, 0.0))):
            sums[k] += np.bincount(of[facing], weights=weights, minlength=sums.shape[1])
    some = np.flatnonzero(sums[0])
    ids = mesh.dictionary.take(pa.array(np.where(some < len(mesh.dictionary), some, 0), mask=some == len(mesh.dictionary)))
    return pa.RecordBatch.from_arrays([ids, pa.array(sums[0][some].astype(np.int64)), pa.array(sums[1][some].astype(np.int64)), pa.array(sums[2][some])], [by, "n_rays", "n_blocked", "total"])


def _candidates(corners: np.ndarray, origins: np.ndarray, s: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(triangles, rays) whose boxes and points meet when seen along the direction; PAIRS at once."""
    seen = lambda p: p[..., :2] - p[..., 2:] * (s[:2] / s[2])
    flat, points = seen(corners), seen(origins)
    if not len(points):
        return
    corner = flat.min(axis=(0, 1)) - 1.0
    flat, points = flat - corner, points - corner
    low, high = flat.min(axis=1) - SLACK, flat.max(axis=1) + SLACK
    level = np.ceil(np.log2(np.maximum((high - low).max(axis=1), 1e-3)))
    for k in np.unique(level):
        width, some = 2.0**k, np.flatnonzero(level == k)
        cell = np.floor(points / width).astype(np.int64)
        across = cell[:, 1].max() + 3
        key = cell[:, 0] * across + cell[:, 1]
        order = np.argsort(key, kind="stable")
        key = key[order]
        i0, j0 = np.floor(low[some] / width).astype(np.int64).T
        i1, j1 = np.floor(high[some] / width).astype(np.int64).T
        for di in (0, 1):
            for dj in (0, 1):  # a triangle is no wider than a cell
                here = np.flatnonzero((i0 + di <= i1) & (j0 + dj <= j1) & (j0 + dj >= 0) & (j0 + dj < across))
                cells = (i0[here] + di) * across + j0[here] + dj
                at, end = np.searchsorted(key, cells, "left"), np.searchsorted(key, cells, "right")
                held = np.flatnonzero(end > at)
                t, at, n = some[here[held]], at[held], (end - at)[held]
                part = (np.cumsum(n) - n) // PAIRS
                edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(t)] if len(t) else []
                for a, b in zip(edges, edges[1:]):
                    m = n[a:b]
                    r = order[np.repeat(at[a:b] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
                    tri = np.repeat(t[a:b], m)
                    near = ((points[r] >= low[tri]) & (points[r] <= high[tri])).all(axis=1)
                    yield tri[near], r[near]
