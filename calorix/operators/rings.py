"""Points in rings, many rings at once.

A ring's edges lie in the slabs of y that they cross, on the level whose slabs are
about as high as the edge, so that none is copied far; a point looks at its one
slab on every level.  Crossings to its right are summed per point: odd is inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calorix.sources.stage import written


def edges(rings: DataFrame, by: tuple[str, ...], ring: str = "ring") -> DataFrame:
    """(by, x0, y0, x1, y1) of all edges that aren't level; the last corner joins the first, whether repeated or not."""
    n = F.size(ring)
    at = lambda k: F.element_at(ring, k)
    pairs = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(at(k)["x"].alias("x0"), at(k)["y"].alias("y0"), at(k % n + 1)["x"].alias("x1"), at(k % n + 1)["y"].alias("y1")))
    return rings.where(n > 2).select(*by, F.inline(pairs)).where("y0 <> y1")


def with_inside(points: DataFrame, rings: DataFrame, by: tuple[str, ...], ring: str = "ring", slab: float = 1.0) -> DataFrame:
    """Points with ``inside``: whether they are in an odd number of their group's rings (so holes are rings too), by the even-odd rule.

    points: by, x, y and other columns; a point on an edge counts by the half-open
    rule, one with a null place is outside; points whose group has no ring are outside.
    """
    sides = edges(rings, by, ring).withColumns({"__lo": F.least("y0", "y1"), "__hi": F.greatest("y0", "y1")})
    sides = written(sides.withColumn("__level", F.greatest(F.lit(0), F.ceil(F.log2((F.col("__hi") - F.col("__lo")) / slab))).cast("int")), "sides")
    levels = sorted(r[0] for r in sides.select("__level").distinct().collect())  # one row per power of two
    height = F.lit(slab) * F.pow(F.lit(2.0), "__level")
    spread = sides.withColumn("__slab", F.explode(F.sequence(F.floor(F.col("__lo") / height), F.floor(F.col("__hi") / height))))
    numbered = written(points.withColumn("__p", F.monotonically_increasing_id()), "points")
    asked = numbered.select(*by, "__p", "x", "y", F.explode(F.array(*map(F.lit, levels or [0]))).alias("__level")).withColumn("__slab", F.floor(F.col("y") / height))
    right = F.col("x") < F.col("x0") + (F.col("y") - F.col("y0")) * ((F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0")))
    met = asked.join(spread, [*by, "__level", "__slab"]).where((F.col("y") >= F.col("__lo")) & (F.col("y") < F.col("__hi")) & right)
    odd = met.groupBy("__p").agg((F.count(F.lit(1)) % 2 == 1).alias("inside"))
    return numbered.join(odd, "__p", "left").withColumn("inside", F.coalesce("inside", F.lit(False))).drop("__p")


def inside_own(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is inside a ring of some corners in its own row, by the rule of ``with_inside``; nothing is shuffled."""
    n = F.size(ring)
    at = lambda k: F.element_at(ring, k)

    def crossed(k: Column) -> Column:
        a, b = at(k), at(k % n + 1)
        within = (y >= F.least(a["y"], b["y"])) & (y < F.greatest(a["y"], b["y"]))
        right = x < a["x"] + (y - a["y"]) * ((b["x"] - a["x"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]))
        return F.when(within & right, 1).otherwise(0)

    crossings = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, k: s + crossed(k))
    return F.coalesce(F.when(n > 2, crossings % 2 == 1), F.lit(False))


def grid(sites: DataFrame, radius: float, step: float) -> DataFrame:
    """Sites with the points of a square grid around each (j outer, i inner): vid, x, y."""
    n = int(2 * radius / step) + 1
    if n < 2 or n * n > 4000:
        raise ValueError("the grid needs 2 to 63 points a side")
    vid = F.col("vid")
    points = sites.withColumn("vid", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))))
    return points.withColumns({"x": F.lit(-radius) + (vid % n) * step, "y": F.lit(-radius) + F.floor(vid / n) * step})


def grid_heights(sites: DataFrame, radius: float, step: float, altitude: Column, ground: Column, ring: str = "ring") -> DataFrame:
    """The grids around sites that have a footprint of some corners in their row: ``terrain_heights`` of their points, by each row alone.

    altitude may use the sites' columns, x and y.  Sites are few and small beside their grids, so they are dealt to all tasks first.
    """
    dealt = sites.repartition(int(sites.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = grid(dealt, radius, step).withColumn("inside", inside_own(F.col("x"), F.col("y"), F.col(ring)))
    return found.withColumn("z", F.when(F.col("inside"), 0.0).otherwise(F.coalesce(altitude - ground, F.lit(0.0)))).drop(ring)


def terrain_heights(points: DataFrame, rings: DataFrame, by: tuple[str, ...], altitude: Column, ground: Column, ring: str = "ring") -> DataFrame:
    """Points with z: the altitude over the ground of their site, 0 under its footprint; without an altitude 0."""
    relative = F.coalesce(altitude - ground, F.lit(0.0))
    return with_inside(points, rings, by, ring).withColumn("z", F.when(F.col("inside"), 0.0).otherwise(relative))
