"""Wall models: resistances, meshes, solar absorption, catalogue, constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Inclusive bounds of layer properties.
LAYER_BOUNDS = {"e": (1e-4, 2.0), "lam": (1e-3, 500.0), "rho": (0.0, 20_000.0), "c": (0.0, 10_000.0), "tau": (0.0, 1.0), "r": (0.0, 1.0), "alpha": (0.0, 1.0)}
# Thickness, conductivity, density, heat capacity and absorptance of opaque materials.
MATERIALS = {
    "thin_render": (0.01, 0.5, 1200.0, 1000.0, 0.5),
    "render": (0.015, 0.87, 1800.0, 1000.0, 0.5),
    "block": (0.20, 1.05, 1400.0, 1000.0, 0.1),
    "plasterboard": (0.013, 0.25, 850.0, 1000.0, 0.1),
    "wool": (0.10, 0.035, 25.0, 1030.0, 0.1),
    "tile": (0.02, 1.0, 2000.0, 800.0, 0.7),
    "deck": (0.018, 0.15, 500.0, 1600.0, 0.1),
    "slab": (0.15, 1.75, 2300.0, 1000.0, 0.1),
    "screed": (0.05, 1.15, 2000.0, 1000.0, 0.1),
    "xps": (0.10, 0.034, 30.0, 1450.0, 0.1),
}
# Outside to inside; the insulation's thickness is the parameter.
STACKS = {
    "external": (("thin_render", "wool", "block", "plasterboard"), (0.10, 0.14, 0.18)),
    "internal": (("render", "block", "wool", "plasterboard"), (0.10, 0.14, 0.18)),
    "roof": (("tile", "deck", "wool", "plasterboard"), (0.20, 0.30, 0.40)),
    "floor": (("slab", "xps", "screed"), (0.04, 0.08, 0.12)),
}
# Panes (thickness, conductivity, transmittance, absorptance) and frame (U, share of the opening).
GLAZINGS = {
    "single": (((0.004, 1.0, 0.87, 0.06),), (2.0, 0.25)),
    "double": (((0.004, 1.0, 0.88, 0.06), (0.016, 0.094, 0.97, 0.02), (0.004, 1.0, 0.88, 0.06)), (1.8, 0.25)),
}


def catalogue(spark: SparkSession) -> DataFrame:
    """Layers of the 14 seed walls: (name, layer_idx, e, lam, rho, c, tau, r, alpha, frame_u, frame_fraction)."""
    rows = []
    for stack, (materials, thicknesses) in STACKS.items():
        for thickness in thicknesses:
            for i, m in enumerate(materials):
                e, lam, rho, c, alpha = MATERIALS[m]
                e = thickness if m in ("wool", "xps") else e
                rows.append((f"{stack} {round(thickness * 100)} cm", i, e, lam, rho, c, 0.0, 1 - alpha, alpha, None, None))
    for name, (panes, (u, share)) in GLAZINGS.items():
        for i, (e, lam, tau, alpha) in enumerate(panes):
            gas = lam < 0.5
            rows.append((f"{name} glazing", i, e, lam, 1.2 if gas else 2500.0, 1000.0 if gas else 750.0, tau, 1 - tau - alpha, alpha, u, share))
    return spark.createDataFrame(rows, "name string, layer_idx int, e double, lam double, rho double, c double, tau double, r double, alpha double, frame_u double, frame_fraction double")


def in_order(field: str) -> Column:
    """A wall's layer values from outside to inside, as an aggregate."""
    return F.transform(F.array_sort(F.collect_list(F.struct("layer_idx", field))), lambda s: s[field])


def u_values(layers: DataFrame, h_e: float = 25.0, h_i: float = 7.7) -> DataFrame:
    """Thermal transmittance per wall; the layers are added in a fixed order."""
    total = F.aggregate(in_order("res"), F.lit(0.0), lambda s, x: s + x)
    return layers.withColumn("res", F.col("e") / F.col("lam")).groupBy("wall_id").agg((1.0 / (1.0 / h_e + total + 1.0 / h_i)).alias("u"))


def mesh_nodes(layers: DataFrame, dx: float) -> DataFrame:
    """Elements of every layer cut to at most dx, with the running coordinate of each element's far node."""
    n = F.greatest(F.lit(1), F.ceil(F.col("e") / dx).cast("int"))
    cut = layers.withColumn("n", n).withColumn("element", F.explode(F.sequence(F.lit(1), n)))
    w = Window.partitionBy("wall_id").orderBy("layer_idx", "element").rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumns({"h": F.col("e") / F.col("n"), "node": F.row_number().over(w)}).withColumn("x", F.sum(F.col("h")).over(w))


def solar_sources(layers: DataFrame, incident: float) -> DataFrame:
    """Per layer what it absorbs (at its surface if opaque, else in its volume), and per wall what passes inside.

    The beam before a layer is the product of the transmittances before it; it
    ends at the first opaque layer or when it falls to nothing.
    """
    w = Window.partitionBy("wall_id").orderBy("layer_idx")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    opaque = (F.col("tau") <= 1e-9).cast("int")
    reached = layers.withColumn("__stop", opaque).withColumn("beam", F.lit(incident) * F.coalesce(F.product("tau").over(before), F.lit(1.0)))
    lit = (F.coalesce(F.max("__stop").over(before), F.lit(0)) == 0) & (F.col("beam") > 1e-9)
    absorbed = F.when(lit, F.col("alpha") * F.col("beam")).otherwise(0.0)
    last = F.row_number().over(Window.partitionBy("wall_id").orderBy(F.desc("layer_idx"))) == 1
    after = F.col("beam") * F.col("tau")
    return reached.select(
        "wall_id",
        "layer_idx",
        F.when(F.col("__stop") == 1, absorbed).otherwise(0.0).alias("surface"),
        F.when(F.col("__stop") == 0, absorbed).otherwise(0.0).alias("volume"),
        F.when(last & lit & (F.col("__stop") == 0) & (after > 1e-9), after).otherwise(0.0).alias("interior"),
    )


def rejects(layers: DataFrame, bounds: dict[str, tuple[float, float]] = LAYER_BOUNDS) -> DataFrame:
    """Layers that break a bound or whose optical shares don't add up to 1, with the reasons."""
    reasons = [F.when(~F.coalesce(F.col(c).between(low, high), F.lit(False)), F.lit(c)) for c, (low, high) in bounds.items()]
    reasons.append(F.when(F.abs(F.col("tau") + F.col("r") + F.col("alpha") - 1.0) > 0.01, F.lit("optics")))
    return layers.withColumn("reasons", F.concat_ws(",", *reasons)).where("reasons <> ''")


def upserted(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of both tables by key, the changes' values first; running it twice changes nothing."""
    fields = [c for c in current.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in fields], F.lit(True).alias("__there"))
    joined = current.join(new, key, "full_outer")
    return joined.select(key, *[F.when(F.col("__there"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in fields])
