"""Rays against large scenes: triangles packed in blocks along a space-filling curve, under a hierarchy of boxes.

Triangles are numbered along the Morton curve of their centres; WIDTH that follow
each other are a block, WIDTH blocks a node of the next level, and so on up to a few
nodes.  Rays meet the top nodes' boxes, then the boxes of the children of those they
meet, and at last the triangles of the blocks.  Every step is an equi-join on the
parent, so neither triangles nor boxes are copied by direction, and far parts of
a scene cost a ray nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calorix.functions import geometry
from calorix.operators.prefix import running
from calorix.sources.stage import short_methods, written

#: Triangles of a block and children of a node; nodes of the top level at most; levels of the curve per axis.
WIDTH, TOP_NODES, CURVE_BITS = 32, 64, 16
#: A ray along a plane (the normal's length is twice the area) or a hit at its origin meets nothing.
FLAT, NEAR = 1e-12, 1e-9
CORNERS = tuple(f"{c}{i}" for i in range(3) for c in "xyz")
BOX = tuple(f"{e}{c}" for e in ("lo_", "hi_") for c in "xyz")


def spread_bits(n: Column) -> Column:
    """The low 16 bits of a number with two zero bits between each."""
    for shift, mask in ((16, 0x0000FF0000FF), (8, 0x00F00F00F00F), (4, 0x0C30C30C30C3), (2, 0x249249249249)):
        n = F.shiftleft(n, shift).bitwiseOR(n).bitwiseAND(F.lit(mask))
    return n


def curve_place(centre: tuple[Column, ...], low: tuple[float, ...], size: float) -> Column:
    """Place on the Morton curve through a cube."""
    cells = [F.least(F.greatest(F.floor((c - a) / size * (1 << CURVE_BITS)), F.lit(0)), F.lit((1 << CURVE_BITS) - 1)).cast("long") for c, a in zip(centre, low)]
    x, y, z = map(spread_bits, cells)
    return x.bitwiseOR(F.shiftleft(y, 1)).bitwiseOR(F.shiftleft(z, 2))


class PackedScene:
    """A scene's written triangles (with ``block``) and, from the top down, its levels of boxes (node, parent, box)."""

    def __init__(self, triangles: DataFrame, width: int = WIDTH):
        """triangles: obj, k (null or at most 0: opaque), corners; other columns aren't kept."""
        centre = tuple((F.col(f"{c}0") + F.col(f"{c}1") + F.col(f"{c}2")) / 3.0 for c in "xyz")
        ends = triangles.agg(*[F.min(c).alias(f"a{n}") for n, c in zip("xyz", centre)], *[F.max(c).alias(f"b{n}") for n, c in zip("xyz", centre)]).first()
        low = tuple(ends[f"a{n}"] or 0.0 for n in "xyz")
        size = max([(ends[f"b{n}"] or 0.0) - a for n, a in zip("xyz", low)] + [1e-9])
        placed = running(triangles.select("obj", "k", *CORNERS, curve_place(centre, low, size).alias("__curve")), ("__curve",))
        placed = written(placed.withColumn("block", F.floor(F.col("place") / width)).drop("__curve", "place"), "scene")
        self.triangles = written(placed.select("obj", "k", "block", *planes()), "planes")
        least, most = ([f(*[f"{c}{i}" for i in range(3)]) for c in "xyz"] for f in (F.least, F.greatest))
        level = placed.groupBy(F.col("block").alias("node")).agg(*[F.min(e).alias(f"lo_{c}") for e, c in zip(least, "xyz")], *[F.max(e).alias(f"hi_{c}") for e, c in zip(most, "xyz")])
        self.levels: list[DataFrame] = []
        while True:
            level = written(level.withColumn("parent", F.floor(F.col("node") / width)), "boxes")
            self.levels.insert(0, level)
            if level.count() <= TOP_NODES:
                break
            level = level.groupBy(F.col("parent").alias("node")).agg(*[F.min(c).alias(c) for c in BOX[:3]], *[F.max(c).alias(c) for c in BOX[3:]])

    def hits(self, rays: DataFrame, key: tuple[str, ...]) -> DataFrame:
        """(key, obj, k, distance) of every triangle that a ray (key, ox, oy, oz, sx, sy, sz) meets."""
        at = rays.select(*key, *[f"{p}{c}" for p in "os" for c in "xyz"])
        at = meets_box(at.crossJoin(F.broadcast(self.levels[0].drop("parent"))))  # of TOP_NODES rows at most
        for level in self.levels[1:]:
            at = meets_box(at.withColumnRenamed("node", "parent").join(level, "parent").drop("parent"))
        met = at.join(self.triangles, F.col("node") == F.col("block"))
        vector = lambda p: tuple(F.col(f"{p}{c}") for c in "xyz")
        over = lambda name, v: geometry.dot(vector(f"{name}_"), vector(v))
        towards, height = over("n", "s"), F.col("n_at") - over("n", "o")
        distance = height / towards
        inside = (F.abs(towards) > FLAT) & (distance > NEAR)
        for name in "uvw":  # shares of the corners where the ray meets the plane
            inside = inside & (over(name, "o") + F.col(f"{name}_at") + distance * over(name, "s") >= 0)
        with short_methods(rays.sparkSession):
            return written(met.where(inside).select(*key, "obj", "k", distance.alias("distance")), "hits")


def planes() -> list[Column]:
    """A triangle's plane (n, n_at: n.p = n_at) and the three shares of its corners in a point p of it (u.p + u_at and so on, none negative inside)."""
    a, b, c = (geometry.corner(i) for i in range(3))
    e1, e2 = geometry.minus(b, a), geometry.minus(c, a)
    n = geometry.cross(e1, e2)
    area = geometry.dot(n, n)
    scaled = lambda v: tuple(x / area for x in v)
    u, v = scaled(geometry.cross(e2, n)), scaled(geometry.cross(n, e1))
    w = tuple(-(x + y) for x, y in zip(u, v))
    named = lambda name, vector, at: [*(x.alias(f"{name}_{axis}") for x, axis in zip(vector, "xyz")), at.alias(f"{name}_at")]
    return [*named("n", n, geometry.dot(n, a)), *named("u", u, -geometry.dot(u, a)), *named("v", v, -geometry.dot(v, a)), *named("w", w, F.lit(1.0) - geometry.dot(w, a))]


def meets_box(pairs: DataFrame, slack: float = 1e-9) -> DataFrame:
    """The pairs whose ray meets the box (lo_x .. hi_z), without the box."""
    near, far = [F.lit(0.0)], []
    outside = F.lit(False)
    for c in "xyz":
        o, s, lo, hi = F.col(f"o{c}"), F.col(f"s{c}"), F.col(f"lo_{c}") - slack, F.col(f"hi_{c}") + slack
        level = F.abs(s) < 1e-15
        outside = outside | (level & ((o < lo) | (o > hi)))
        a, b = (lo - o) / s, (hi - o) / s
        near.append(F.when(~level, F.least(a, b)))
        far.append(F.when(~level, F.greatest(a, b)))
    # Of directions along an axis the others decide; greatest and least skip nulls.
    return pairs.where(~outside & (F.greatest(*near) <= F.least(*far))).drop(*BOX)
