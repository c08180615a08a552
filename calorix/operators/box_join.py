"""Sites and the points in their boxes, joined on cells that are small where points are dense.

A quadtree over latitude and longitude is made from counts alone: cells that hold
more points than wanted are counted again one step finer, until none does or the
finest level is reached.  Points go to their one leaf; a site's box goes down the
tree from the coarse cells to the leaves it meets, so that neither side is copied
to fine cells where there are few points.  Rows then meet by leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calorix.functions import geodesy
from calorix.sources.stage import written

#: Level of the coarsest and the finest cells (a level has 2^level cells a side), halvings a step, points wanted in a leaf.
TOP, FINEST, STEP, WANTED = 5, 23, 3, 20_000
#: Leaves of at most this many rows may be broadcast (20 bytes each).
BROADCAST_ROWS = 500_000


def cell_of(lat: Column, lon: Column, level: int) -> Column:
    """The cell of a place on a level as one number: rows from south, columns from west."""
    n = 1 << level
    at = lambda c, low, span: F.least(F.greatest(F.floor((c - low) / span * n), F.lit(0)), F.lit(n - 1)).cast("long")
    return at(lat, -90.0, 180.0) * n + at(lon, -180.0, 360.0)


def levels(finest: int = FINEST) -> list[int]:
    return list(range(TOP, finest + 1, STEP))


def leaves(points: DataFrame, wanted: int = WANTED, finest: int = FINEST) -> DataFrame:
    """(level, cell, n, leaf): all cells of the tree with points; ``leaf`` is false where finer ones take over."""
    tree, left = None, points.select("lat", "lon")
    for level in levels(finest):
        counts = written(left.groupBy(cell_of(F.col("lat"), F.col("lon"), level).alias("cell")).agg(F.count(F.lit(1)).alias("n")), "cells")
        leaf = (F.col("n") <= wanted) if level + STEP <= finest else F.lit(True)
        here = counts.select(F.lit(level).alias("level"), "cell", "n", leaf.alias("leaf"))
        tree = here if tree is None else tree.unionByName(here)
        hot = here.where("not leaf").select("cell")
        if (n := hot.count()) == 0:
            break
        few = F.broadcast(hot) if n <= BROADCAST_ROWS else hot
        left = left.withColumn("cell", cell_of(F.col("lat"), F.col("lon"), level)).join(few, "cell", "left_semi").select("lat", "lon")
    return tree


def placed(points: DataFrame, tree: DataFrame, finest: int = FINEST) -> DataFrame:
    """Points with ``__level`` and ``__cell`` of their leaf."""
    at = F.array(*[F.struct(F.lit(level).alias("l"), cell_of(F.col("lat"), F.col("lon"), level).alias("c")) for level in levels(finest)])
    own = tree.where("leaf").select(F.col("level").alias("__level"), F.col("cell").alias("__cell"))
    own = F.broadcast(own) if own.count() <= BROADCAST_ROWS else own
    return points.withColumn("__at", F.explode(at)).withColumns({"__level": F.col("__at.l"), "__cell": F.col("__at.c")}).drop("__at").join(own, ["__level", "__cell"])


def covered(sites: DataFrame, tree: DataFrame, finest: int = FINEST) -> DataFrame:
    """Sites (with __s, __n, __w, __e) with ``__level`` and ``__cell`` of every leaf that their box meets."""
    def index(c: Column, level: int, low: float, span: float) -> Column:
        n = 1 << level
        return F.least(F.greatest(F.floor((c - low) / span * n), F.lit(0)), F.lit(n - 1)).cast("long")

    def within(level: int, low: str, high: str, start: float, span: float, parent: str | None = None) -> Column:
        """Rows or columns of a level that the box meets, of those of a parent if given."""
        first, last = index(F.col(low), level, start, span), index(F.col(high), level, start, span)
        if parent is not None:
            first, last = F.greatest(first, F.shiftleft(parent, STEP)), F.least(last, F.shiftleft(parent, STEP) + (1 << STEP) - 1)
        return F.explode(F.sequence(first, last))

    columns, out = sites.columns, None
    inside = sites.withColumn("__i", within(TOP, "__s", "__n", -90.0, 180.0)).withColumn("__j", within(TOP, "__w", "__e", -180.0, 360.0))
    for level in levels(finest):
        known = tree.where(F.col("level") == level).select(F.col("cell").alias("__cell"), F.col("leaf").alias("__leaf"))
        met = inside.withColumn("__cell", F.shiftleft("__i", level) + F.col("__j")).join(known, "__cell")
        ended = met.where("__leaf").select(*columns, F.lit(level).alias("__level"), "__cell")
        out = ended if out is None else out.unionByName(ended)
        if tree.where((F.col("level") == level) & ~F.col("leaf")).isEmpty():
            break
        # On to the children of inner cells that meet the box.
        down = met.where("not __leaf").drop("__leaf", "__cell")
        inside = down.withColumn("__i", within(level + STEP, "__s", "__n", -90.0, 180.0, "__i")).withColumn("__j", within(level + STEP, "__w", "__e", -180.0, 360.0, "__j"))
    return out


def in_boxes(sites: DataFrame, points: DataFrame, radius_m: float, wanted: int = WANTED, finest: int = FINEST) -> DataFrame:
    """Site x point pairs within each site's box, with x, y and dist in metres; rows without a place meet nothing.

    sites: lat, lon (become site_lat, site_lon) and other columns; points: lat, lon and other columns.
    """
    dlat, dlon = geodesy.half_box(F.col("lat"), radius_m)
    boxed = sites.where("lat is not null and lon is not null").withColumns({"__s": F.col("lat") - dlat, "__n": F.col("lat") + dlat, "__w": F.col("lon") - dlon, "__e": F.col("lon") + dlon})
    points = points.where("lat is not null and lon is not null")
    tree = written(leaves(points, wanted, finest), "tree")
    pairs = covered(boxed.withColumnsRenamed({"lat": "site_lat", "lon": "site_lon"}), tree, finest).join(placed(points, tree, finest), ["__level", "__cell"])
    pairs = pairs.where(F.col("lat").between(F.col("__s"), F.col("__n")) & F.col("lon").between(F.col("__w"), F.col("__e")))
    x, y = geodesy.project(F.col("lat"), F.col("lon"), F.col("site_lat"), F.col("site_lon"))
    return pairs.withColumns({"x": x, "y": y}).withColumn("dist", F.hypot("x", "y")).drop("__level", "__cell", "__s", "__n", "__w", "__e")
