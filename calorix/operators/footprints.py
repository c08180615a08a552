"""Footprints: ring repair, extrusion into grouped triangles, crowns, overlap with a convex study polygon."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_AREA = 1e-3
LEAST_HEIGHT = 1.0
SELF_OVERLAP, SLIVER = 0.3, 1.0
POINT = "struct<x:double,y:double>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def after(ring: Column, i: Column) -> Column:
    """The point that follows the i-th (from 0), around the ring."""
    return F.get(ring, (i + 1) % F.size(ring))


def places(ring: Column) -> Column:
    """0 to n - 1, empty for an empty ring."""
    return F.when(F.size(ring) > 0, F.sequence(F.lit(0), F.size(ring) - 1)).otherwise(F.array().cast("array<int>"))


def signed_area(ring: Column) -> Column:
    """Shoelace area, positive for rings that turn left."""

    def edge(i: Column) -> Column:
        p, q = F.get(ring, i), after(ring, i)
        return p["x"] * q["y"] - q["x"] * p["y"]

    return F.aggregate(F.transform(places(ring), edge), F.lit(0.0), lambda s, x: s + x) / 2.0


def open_ring(ring: Column) -> Column:
    """The ring without a repeated closing point."""
    closed = (F.size(ring) > 1) & (F.get(ring, F.lit(0)) == F.get(ring, F.size(ring) - 1))
    return F.when(closed, F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))).otherwise(ring)


def repaired(footprints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Footprints with open rings that turn left, and those that have no usable ring."""
    rings = footprints.withColumn("ring", open_ring(F.col("ring"))).withColumn("area", F.abs(signed_area(F.col("ring"))))
    ok = F.coalesce((F.size("ring") >= 3) & (F.col("area") >= LEAST_AREA), F.lit(False))
    turned = rings.where(ok).withColumn("ring", F.when(signed_area(F.col("ring")) < 0, F.reverse("ring")).otherwise(F.col("ring")))
    return turned, rings.where(~ok)


def ears(x: np.ndarray, y: np.ndarray) -> list[list[int]]:
    """Triangles of a simple ring that turns left, by cutting ears."""
    left, out = list(range(len(x))), []
    turn = lambda a, b, c: (x[b] - x[a]) * (y[c] - y[a]) - (x[c] - x[a]) * (y[b] - y[a])
    while len(left) > 3:
        for k in range(len(left)):
            a, b, c = left[k - 1], left[k], left[(k + 1) % len(left)]
            if turn(a, b, c) > 0 and not any(turn(a, b, p) >= 0 and turn(b, c, p) >= 0 and turn(c, a, p) >= 0 for p in left if p not in (a, b, c)):
                break
        else:
            k = 0  # only flat corners are left
        out.append([left[k - 1], left[k], left[(k + 1) % len(left)]])
        del left[k]
    return [*out, left]


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def cap_triangles(rings: pd.Series) -> pd.Series:
    """Corner numbers of the triangles that fill each ring."""
    return rings.map(lambda r: ears(np.array([p["x"] for p in r]), np.array([p["y"] for p in r])))


def extruded(footprints: DataFrame) -> DataFrame:
    """Triangles of (id, ring, height, base) prisms: sol and toit caps, two per wall mur_1, mur_2, ...; heights are at least 1 m."""
    flat, top = F.col("base"), F.col("base") + F.greatest(F.col("height"), F.lit(LEAST_HEIGHT))
    rings = repaired(footprints)[0].withColumn("caps", cap_triangles("ring")).withColumns({"z0": flat, "z1": top})
    corner = lambda p, z: F.struct(p["x"].alias("x"), p["y"].alias("y"), z.alias("z"))
    face = lambda grp, a, b, c: F.struct(grp.alias("grp"), a.alias("a"), b.alias("b"), c.alias("c"))
    at = lambda i: F.get("ring", i)
    z0, z1 = F.col("z0"), F.col("z1")
    floor = F.transform("caps", lambda t: face(F.lit("sol"), corner(at(t[0]), z0), corner(at(t[2]), z0), corner(at(t[1]), z0)))
    roof = F.transform("caps", lambda t: face(F.lit("toit"), corner(at(t[0]), z1), corner(at(t[1]), z1), corner(at(t[2]), z1)))

    def wall(i: Column) -> Column:
        p, q, name = at(i), after(F.col("ring"), i), F.concat(F.lit("mur_"), i + 1)
        return F.array(face(name, corner(p, z0), corner(q, z0), corner(q, z1)), face(name, corner(p, z0), corner(q, z1), corner(p, z1)))

    walls = F.flatten(F.transform(places(F.col("ring")), wall))
    rows = rings.select("id", F.posexplode(F.concat(floor, roof, walls)).alias("tri_id", "f"))
    return rows.select("id", "tri_id", "f.grp", *[F.col(f"f.{p}.{x}").alias(f"{x}{i}") for i, p in enumerate("abc") for x in "xyz"])


def crown(x: Column, y: Column, radius: Column, sides: int = 8) -> Column:
    """Ring of a regular crown around a point."""
    return F.transform(F.sequence(F.lit(0), F.lit(sides - 1)), lambda i: point(x + radius * F.cos(i * (2 * math.pi / sides)), y + radius * F.sin(i * (2 * math.pi / sides))))


def half_plane_cut(ring: Column, a: tuple[float, float], b: tuple[float, float]) -> Column:
    """The part of a ring on the left of the line from a to b."""
    none = F.array().cast(f"array<{POINT}>")

    def side(p: Column) -> Column:
        return (p["y"] - a[1]) * (b[0] - a[0]) - (p["x"] - a[0]) * (b[1] - a[1])

    def cut(i: Column) -> Column:
        p, q = F.get(ring, i), after(ring, i)
        s, t = side(p), side(q)
        share = s / (s - t)
        meet = point(p["x"] + (q["x"] - p["x"]) * share, p["y"] + (q["y"] - p["y"]) * share)
        return F.concat(F.when(s >= 0, F.array(point(p["x"], p["y"]))).otherwise(none), F.when((s > 0) & (t < 0) | (s < 0) & (t > 0), F.array(meet)).otherwise(none))

    return F.flatten(F.transform(places(ring), cut))


def overlaps(candidates: DataFrame, study: list[tuple[float, float]]) -> DataFrame:
    """Status of candidate rings against a convex study ring, with the overlap and the area left outside.

    degenerate: no area; kept: no overlap (walls may touch); self: overlap over
    union above 0.3, or less than 1 m2 left outside; else clipped.
    """
    if not study:
        return candidates.withColumns({"area": F.abs(signed_area(F.col("ring"))), "overlap": F.lit(0.0)}).withColumns({"left": F.col("area"), "status": F.lit("kept")})
    turn = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(study, study[1:] + study[:1])) / 2
    study, whole = study if turn > 0 else study[::-1], abs(turn)
    corner = zip(study, study[1:] + study[:1], study[2:] + study[:2])
    if any((b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0]) < -1e-9 for a, b, c in corner):
        raise ValueError("the study ring is not convex: use polygons.resolved")
    out = candidates.withColumns({"area": F.abs(signed_area(F.col("ring"))), "__in": F.col("ring")})
    for a, b in zip(study, study[1:] + study[:1]):  # each cut in a column of its own, so that every ring is built once
        out = out.withColumn("__in", half_plane_cut(F.col("__in"), a, b))
    out = out.withColumn("overlap", F.when(F.size("__in") >= 3, F.abs(signed_area(F.col("__in")))).otherwise(0.0)).drop("__in")
    out = out.withColumn("left", F.col("area") - F.col("overlap"))
    share = F.col("overlap") / (F.col("area") + whole - F.col("overlap"))
    status = F.when(F.col("area") < 1e-9, "degenerate").when(F.col("overlap") <= 1e-9, "kept").when((share > SELF_OVERLAP) | (F.col("left") < SLIVER), "self").otherwise("clipped")
    return out.withColumn("status", status)
