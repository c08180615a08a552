"""Sites, candidates near them, admission by rank and by running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calorix.functions import geodesy
from calorix.operators.prefix import running


def in_boxes(sites: DataFrame, points: DataFrame, radius_m: float, cell_deg: float = 1.0) -> DataFrame:
    """Site x point pairs within each site's box: an equi-join on grid cells, then the exact box.

    Each site lists the cells its box covers, so no pair is missed and none
    doubled; a denser grid cuts candidates, a coarser one the sites' copies.
    """
    dlat, dlon = geodesy.half_box(F.col("lat"), radius_m)
    boxed = sites.withColumns({"__s": F.col("lat") - dlat, "__n": F.col("lat") + dlat, "__w": F.col("lon") - dlon, "__e": F.col("lon") + dlon})
    cell = lambda c: F.floor(F.col(c) / cell_deg).cast("int")
    covered = (
        boxed.withColumn("__i", F.explode(F.sequence(cell("__s"), cell("__n"))))
        .withColumn("__j", F.explode(F.sequence(cell("__w"), cell("__e"))))
        .withColumnsRenamed({"lat": "site_lat", "lon": "site_lon"})
    )
    placed = points.withColumns({"__i": cell("lat"), "__j": cell("lon")})
    pairs = covered.join(placed, ["__i", "__j"]).where(F.col("lat").between(F.col("__s"), F.col("__n")) & F.col("lon").between(F.col("__w"), F.col("__e")))
    x, y = geodesy.project(F.col("lat"), F.col("lon"), F.col("site_lat"), F.col("site_lon"))
    return pairs.withColumns({"x": x, "y": y}).withColumn("dist", F.hypot("x", "y")).drop("__i", "__j", "__s", "__n", "__w", "__e")


def nearest_accepted(pairs: DataFrame, accepted, k: int, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The k nearest accepted rows per group, with the number of rejected rows that rank before the k-th accepted one."""
    w = Window.partitionBy(*by).orderBy(*order)
    ok = accepted.cast("int")
    ranked = pairs.withColumn("__ok", ok).withColumn("__upto", F.sum("__ok").over(w))
    seen = ranked.withColumn("__skipped", F.sum(F.when((F.col("__ok") == 0) & (F.col("__upto") < k), 1).otherwise(0)).over(Window.partitionBy(*by)))
    return seen.where((F.col("__ok") == 1) & (F.col("__upto") <= k)).withColumnsRenamed({"__upto": "rank", "__skipped": "skipped"}).drop("__ok")


def nearest_in_boxes(sites: DataFrame, points: DataFrame, radius_m: float, accepted, k: int, order: str, cell_deg: float = 1.0) -> DataFrame:
    """Every site with the k nearest accepted points of its box by (dist, ``order``), with rank and skipped as ``nearest_accepted`` has them.

    Sites in one place have one search.  Of points in one place only those up to the
    k-th accepted one by ``order`` can be found or count as skipped, so that the
    pairs grow with the places of both sides, not with their rows.
    """
    ahead = F.sum(accepted.cast("int")).over(Window.partitionBy("lat", "lon").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    first = points.withColumn("__ahead", F.coalesce(ahead, F.lit(0))).where(F.col("__ahead") < k).drop("__ahead")
    pairs = in_boxes(sites.select("lat", "lon").distinct(), first, radius_m, cell_deg)
    found = nearest_accepted(pairs, accepted, k, ("site_lat", "site_lon"), ("dist", order))
    return sites.withColumnsRenamed({"lat": "site_lat", "lon": "site_lon"}).join(found, ["site_lat", "site_lon"])


def admitted(items: DataFrame, sizes: tuple[str, ...], caps: tuple[int, ...], order: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Items in order until a running total would pass its cap, with each one's offset: the totals before it.

    Sizes are at least 1; smaller ones are an error.  Totals only grow, so the
    items within the caps are the first ones of each group, of whatever size.
    """
    sized = items.withColumns({c: F.when(F.col(c) >= 1, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} must be at least 1"))) for c in sizes})
    keep = F.lit(True)
    for c, cap in zip(sizes, caps):
        keep = keep & (F.col(f"{c}_before") + F.col(c) <= cap)
    out = running(sized, order, sizes, by).where(keep)
    return out.withColumnsRenamed({f"{c}_before": f"{c}_offset" for c in sizes}).drop("place")


def nearest(items: DataFrame, k: int, order: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """The k nearest items (of each group)."""
    if not by:
        return items.orderBy(*order).limit(k)
    return items.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= k).drop("__n")


def with_addition(base: DataFrame, addition: DataFrame, sizes: tuple[str, ...], caps: tuple[int, ...]) -> DataFrame:
    """Both lists in one if their totals are within the caps, else the base alone: an addition goes in whole or not at all."""
    totals = base.select(*sizes).unionByName(addition.select(*sizes)).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sizes]).first()
    return base.unionByName(addition, allowMissingColumns=True) if all(t <= cap for t, cap in zip(totals, caps)) else base


def accumulated(zones: DataFrame, trees: DataFrame, other_zones: DataFrame, in_country) -> DataFrame:
    """Vegetation of all sources together; the second source's zones count abroad only."""
    return zones.unionByName(trees, allowMissingColumns=True).unionByName(other_zones.where(~in_country), allowMissingColumns=True)


def source_stats(items: DataFrame, status: str = "status", used: str = "used") -> DataFrame:
    """One row: how many items there are, are used, are the study building itself, are clipped, and are skipped (all but used and self)."""
    n = F.count(F.lit(1))
    own, taken = F.count_if(F.col(status) == "self"), F.count_if(F.col(used))
    return items.agg(n.alias("n_total"), taken.alias("n_used"), own.alias("n_self"), F.count_if((F.col(status) == "clipped") & F.col(used)).alias("n_clipped"), (n - taken - own).alias("n_skipped"))


def base_altitudes(items: DataFrame, lookup: DataFrame, ground_ref: float, key: str) -> DataFrame:
    """Altitude over the reference: the item's own, else the looked-up one (only for items without their own), else 0."""
    missing = items.where(F.col("base_z").isNull()).select(key)
    found = lookup.join(missing, key, "left_semi").select(key, F.col("altitude").alias("__found"))
    relative = F.coalesce(F.col("base_z") - ground_ref, F.col("__found") - ground_ref, F.lit(0.0))
    return items.join(found, key, "left").withColumn("base_rel", relative).drop("__found")
