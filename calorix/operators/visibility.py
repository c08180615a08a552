"""Rays against triangles: culling, occlusion, transmission, sky view, nearest-cell lookup.

The join of rays and triangles is made an equi-join: both are placed on the plane
across the ray's direction, triangles in all cells that their bounding box
covers, rays in the one cell of their origin; the exact test follows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calorix.functions import geometry, physics
from calorix.functions.rounding import half_even
from calorix.functions.solar import direction

STEP_DEG = 15
N_AZ, N_EL = 360 // STEP_DEG, 90 // STEP_DEG + 1
CULL = 1e-6
LIFT = 1e-3


def sun_grid(spark: SparkSession) -> DataFrame:
    """Directions every 15 degrees: azimuth without 360, elevation with 90."""
    az, el = (F.col("id") % N_AZ).cast("int"), F.floor(F.col("id") / N_AZ).cast("int")
    grid = spark.range(N_AZ * N_EL).select(az.alias("az_idx"), el.alias("el_idx"))
    s = direction((F.col("az_idx") * STEP_DEG).cast("double"), (F.col("el_idx") * STEP_DEG).cast("double"))
    return grid.withColumns(dict(zip(("sx", "sy", "sz"), s)))


def sky_directions(spark: SparkSession, n: int = 128) -> DataFrame:
    """Evenly spread directions on the sphere, pole on the y axis; those above the horizon."""
    i = F.col("id")
    y = 1.0 - 2.0 * i / (n - 1)
    rho, theta = F.sqrt(F.greatest(F.lit(0.0), 1.0 - y * y)), i * (math.pi * (3.0 - math.sqrt(5.0)))
    return spark.range(n).select(i.cast("int").alias("dir"), (rho * F.cos(theta)).alias("sx"), y.alias("sy"), (rho * F.sin(theta)).alias("sz")).where("sz > 0")


def with_origins(triangles: DataFrame) -> DataFrame:
    """Ray origins: centroids lifted a little along the normal."""
    return triangles.withColumns({f"o{x}": (F.col(f"{x}0") + F.col(f"{x}1") + F.col(f"{x}2")) / 3.0 + LIFT * F.col(f"n{x}") for x in "xyz"})


def facing(surfaces: DataFrame, directions: DataFrame, least: float = CULL) -> DataFrame:
    """Surface x direction pairs that face each other, with the cosine."""
    pairs = surfaces.crossJoin(F.broadcast(directions))  # directions are a fixed grid
    return pairs.withColumn("cos", F.col("nx") * F.col("sx") + F.col("ny") * F.col("sy") + F.col("nz") * F.col("sz")).where(F.col("cos") > least)


def on_plane(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Coordinates on the plane across the direction (sx, sy, sz); any perpendicular pair does, so long as both sides use it."""
    flat = F.sqrt(F.col("sx") ** 2 + F.col("sy") ** 2)
    a = F.when(flat < 1e-9, 1.0).otherwise(F.col("sy") / flat)
    b = F.when(flat < 1e-9, 0.0).otherwise(-F.col("sx") / flat)
    # (a, b, 0) and its cross product with the direction
    return a * x + b * y, F.col("sz") * (a * y - b * x) + (F.col("sx") * b - F.col("sy") * a) * z


def hits(rays: DataFrame, triangles: DataFrame, ray_key: tuple[str, ...], by: tuple[str, ...], directions: DataFrame, cell: float = 2.0) -> DataFrame:
    """(ray key, obj, k) of every triangle a ray meets; ``by`` names the direction in both.

    Cells double in size from level to level; a triangle is on the level whose
    cells are as large as its extent, so it covers a few cells whatever its size,
    and a ray looks once on every level that has triangles.  The directions are a
    fixed grid or the hours of a series: at most a year's.
    """
    corners = [f"{x}{i}" for i in range(3) for x in "xyz"]
    extent = F.sqrt(sum(((F.greatest(*[f"{x}{i}" for i in range(3)]) - F.least(*[f"{x}{i}" for i in range(3)])) ** 2 for x in "xyz"), F.lit(0.0)))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(extent, F.lit(cell)) / cell))).cast("int")
    sized = triangles.select("obj", "k", *corners, level.alias("__level"))
    levels = sorted(r[0] for r in sized.select("__level").distinct().collect())  # one row per power of two
    width = F.lit(cell) * F.pow(F.lit(2.0), "__level")
    u, v = on_plane(F.col("ox"), F.col("oy"), F.col("oz"))
    at = rays.select(*ray_key, *[c for c in by if c not in ray_key], "ox", "oy", "oz", "sx", "sy", "sz", F.explode(F.array(*map(F.lit, levels or [0]))).alias("__level"))
    at = at.withColumns({"__i": F.floor(u / width), "__j": F.floor(v / width)})
    uv = [on_plane(*geometry.corner(i)) for i in range(3)]
    span = lambda n: F.sequence(F.floor(F.least(*[p[n] for p in uv]) / width), F.floor(F.greatest(*[p[n] for p in uv]) / width))
    seen = sized.crossJoin(F.broadcast(directions.select(*by, "sx", "sy", "sz")))
    cells = seen.withColumn("__i", F.explode(span(0))).withColumn("__j", F.explode(span(1))).drop("sx", "sy", "sz")
    met = at.join(cells, [*by, "__level", "__i", "__j"])
    distance = geometry.hit_distance(tuple(F.col(f"o{x}") for x in "xyz"), tuple(F.col(f"s{x}") for x in "xyz"), *(geometry.corner(i) for i in range(3)))
    return met.where(distance.isNotNull()).select(*ray_key, "obj", "k")


def visible_fraction(rays: DataFrame, met: DataFrame, ray_key: tuple[str, ...], digits: int | None = 3) -> DataFrame:
    """Rays with ``frac``: 0 behind an opaque triangle, else the product of transmittances over distinct objects."""
    opaque = F.col("k").isNull() | (F.col("k") <= 0)
    # An object's triangles share one k (see ``one_scene``), so which of those met is taken doesn't matter.
    per_object = met.groupBy(*ray_key, "obj").agg(F.bool_or(opaque).alias("opaque"), F.max(F.when(~opaque, F.col("k"))).alias("k"))
    seen = per_object.groupBy(*ray_key).agg(F.when(F.bool_or("opaque"), 0.0).otherwise(F.product("k")).alias("__f"))
    frac = F.coalesce("__f", F.lit(1.0))
    return rays.join(seen, list(ray_key), "left").withColumn("frac", half_even(frac, digits) if digits is not None else frac).drop("__f")


def hourly_fractions(surfaces: DataFrame, hours: DataFrame, occluders: DataFrame | None, key: tuple[str, ...]) -> DataFrame:
    """Visible fraction of every surface and sunlit hour at the sun's exact angle, not rounded; without occluders nothing blocks.

    surfaces: key, origin and normal; hours (a year at most): seq, azimuth, elevation.
    """
    s = direction(F.col("azimuth"), F.col("elevation"))
    sunlit = hours.where("elevation > 0").select("seq", *[c.alias(n) for c, n in zip(s, ("sx", "sy", "sz"))])
    rays = facing(surfaces, sunlit)
    if occluders is None:
        return rays.withColumn("frac", F.lit(1.0))
    return visible_fraction(rays, hits(rays, occluders, (*key, "seq"), ("seq",), sunlit), (*key, "seq"), None)


def one_scene(envelopes: dict[str, DataFrame]) -> DataFrame:
    """Triangles of several envelopes as occluders: an object of one is never that of another, and an object's k is its first triangle's.

    A triangle is see-through where k is above 0; those without an object form one per envelope.
    """
    parts = []
    for name, triangles in envelopes.items():
        see_through = F.coalesce(F.col("k") > 0, F.lit(False))
        obj = F.when(see_through, F.concat(F.lit(f"{name}:"), F.coalesce(F.col("obj").cast("string"), F.lit("")))).otherwise(F.lit(f"{name}#opaque"))
        own = triangles.withColumns({"obj": obj, "k": F.when(see_through, F.col("k").cast("double"))})
        first = own.where("k is not null").groupBy("obj").agg(F.min_by("k", "tri_id").alias("__k"))
        parts.append(own.join(first, "obj", "left").withColumn("k", F.col("__k")).select("obj", "k", *[f"{x}{i}" for i in range(3) for x in "xyz"]))
    scene = parts[0]
    for p in parts[1:]:
        scene = scene.unionByName(p)
    return scene


def sky_factors(rays: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Cosine-weighted open share of the sky times the free sky's factor; 0 where no direction is seen."""
    return rays.groupBy(*key).agg((F.coalesce(F.sum(F.col("cos") * F.col("frac")) / F.sum("cos"), F.lit(0.0)) * physics.sky_view(F.first("tilt"))).alias("f_sky"))


def nearest_cell(azimuth: Column, elevation: Column) -> tuple[Column, Column]:
    """Grid cell of a sun position: azimuth wraps, elevation is clamped and ties go to the lower index."""
    az = F.pmod(half_even(F.pmod(azimuth, F.lit(360.0)) / STEP_DEG), F.lit(N_AZ)).cast("int")
    e = F.greatest(F.lit(0.0), F.least(F.lit(90.0), elevation)) / STEP_DEG
    return az, F.ceil(e - 0.5).cast("int")
