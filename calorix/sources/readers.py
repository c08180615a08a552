"""Readers of the services' response shapes and of mesh and text files, as typed DataFrames.

Schemas are declared, never inferred.  All readers take paths that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calorix.sources import stl
from calorix.sources.boxed import scan

CHANNELS = {"temperature_2m": "t_ext_raw", "direct_normal_irradiance": "e_dir_raw", "diffuse_radiation": "e_dif_raw", "wind_speed_10m": "wind_raw"}
ARCHIVE = "hourly struct<time array<string>, " + ", ".join(f"{c} array<double>" for c in CHANNELS) + ">"
TYPICAL = "outputs struct<tmy_hourly array<struct<`time(UTC)` string, T2m double, `Gb(n)` double, `Gd(h)` double, WS10m double>>>"
STOREY_M, DEFAULT_HEIGHT_M = 3.0, 6.0
BBox = tuple[float, float, float, float]
# Height (m), transmittance in leaf and bare, by kind of vegetation; None is the default.
VEGETATION = {
    "Bois": (15.0, 0.15, 0.45), "Forêt fermée de feuillus": (20.0, 0.10, 0.40), "Forêt fermée de conifères": (20.0, 0.08, 0.10), "Forêt fermée mixte": (20.0, 0.10, 0.25),
    "Forêt ouverte": (15.0, 0.30, 0.55), "Haie": (3.0, 0.20, 0.45), "Lande ligneuse": (2.0, 0.35, 0.55), "Verger": (5.0, 0.25, 0.55), "Vigne": (2.0, 0.40, 0.70),
    "Peupleraie": (20.0, 0.15, 0.45), None: (10.0, 0.20, 0.50),
}


def archive_hours(spark: SparkSession, path: str) -> DataFrame:
    """Columnar hourly response to rows: ragged arrays give null, and the time array alone decides which hours there are."""
    doc = spark.read.schema(ARCHIVE).option("multiLine", True).json(path)
    zipped = F.arrays_zip("hourly.time", *[f"hourly.{c}" for c in CHANNELS])
    rows = doc.select(F.posexplode(zipped).alias("seq", "r")).where("r.time is not null")
    return rows.select("seq", F.to_timestamp(F.col("r.time"), "yyyy-MM-dd'T'HH:mm").cast("timestamp_ntz").alias("hour_ts"), *[F.col(f"r.{c}").alias(n) for c, n in CHANNELS.items()])


def typical_hours(spark: SparkSession, path: str) -> DataFrame:
    """Row-oriented typical-year response to rows; times that can't be read are null."""
    doc = spark.read.schema(TYPICAL).option("multiLine", True).json(path)
    rows = doc.select(F.posexplode("outputs.tmy_hourly").alias("seq", "r"))
    return rows.select("seq", F.try_to_timestamp(F.col("r.`time(UTC)`"), F.lit("yyyyMMdd:HHmm")).cast("timestamp_ntz").alias("hour_ts"), F.col("r.T2m").alias("t_ext_raw"), F.col("r.`Gb(n)`").alias("e_dir_raw"), F.col("r.`Gd(h)`").alias("e_dif_raw"), F.col("r.WS10m").alias("wind_raw"))


def first_number(text: Column) -> Column:
    """The first number in a free-text measure, or null."""
    return F.regexp_extract(text, r"([-+]?\d*\.?\d+)", 1).try_cast("double")


def height_of(height: Column, storeys: Column) -> tuple[Column, Column]:
    """Height from the attribute, else storeys times 3 m, else 6 m, and whether it is an estimate; 0 counts as missing."""
    known, counted = F.nullif(height, F.lit(0.0)), F.nullif(storeys, F.lit(0.0)) * STOREY_M
    return F.coalesce(known, counted, F.lit(DEFAULT_HEIGHT_M)), known.isNull()


def crown_radius(diameter: Column, circumference: Column) -> Column:
    """Half the crown's diameter, else 2.5 times the trunk's circumference within 1.5 to 8 m, else 3 m; 0 counts as missing."""
    by_trunk = F.when(F.nullif(circumference, F.lit(0.0)).isNotNull(), F.greatest(F.lit(1.5), F.least(F.lit(8.0), circumference * 2.5)))
    return F.coalesce(F.nullif(diameter, F.lit(0.0)) / 2.0, by_trunk, F.lit(3.0))


def tree_profile(leaf_type: Column) -> Column:
    """Profile of a tree by its leaf type; broadleaf if unknown."""
    pick = lambda h, k, bare: F.struct(F.lit(h).alias("height"), F.lit(k).alias("k"), F.lit(bare).alias("k_bare"))
    return F.when(F.lower(leaf_type) == "needleleaved", pick(14.0, 0.12, 0.15)).otherwise(pick(12.0, 0.20, 0.55))


def ring_centre(ring: Column) -> tuple[Column, Column]:
    """Mean of the ring's points, a repeated closing point included."""
    mean = lambda n: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[n]) / F.size(ring)
    return mean("lat"), mean("lon")


def touches(ring: Column, bbox: BBox | None) -> Column:
    """Whether a ring's own box meets (south, west, north, east), as scans decide it; always, without one."""
    if bbox is None:
        return F.lit(True)
    south, west, north, east = bbox
    least = lambda n: F.array_min(F.transform(ring, lambda p: p[n]))
    most = lambda n: F.array_max(F.transform(ring, lambda p: p[n]))
    return (least("lat") <= north) & (most("lat") >= south) & (least("lon") <= east) & (most("lon") >= west)


def feature_buildings(spark: SparkSession, path: str, limit: int | None = 1000, bbox: BBox | None = None) -> DataFrame:
    """Building footprints of a feature collection, of a box if given, with height, estimate flag and centre; rings of fewer than three points are dropped."""
    height, rough = height_of(F.element_at("tags", "hauteur").try_cast("double"), F.element_at("tags", "nombre_d_etages").try_cast("double"))
    lat, lon = ring_centre(F.col("ring"))
    rows = scan(spark, path, bbox, limit).where(F.size("ring") >= 3)
    return rows.select("file", "at", "ring", height.alias("height"), rough.alias("approx"), lat.alias("lat"), lon.alias("lon"), F.element_at("tags", "altitude_minimale_sol").try_cast("double").alias("base_z"))


def feature_vegetation(spark: SparkSession, path: str, limit: int | None = 1000, bbox: BBox | None = None) -> DataFrame:
    """Vegetation zones, of a box if given, with the profile of their kind."""
    known = F.create_map(*[x for n, v in VEGETATION.items() if n for x in (F.lit(n), F.array(*map(F.lit, v)))])
    profile = F.coalesce(F.try_element_at(known, F.element_at("tags", "nature")), F.array(*map(F.lit, VEGETATION[None])))
    rows = scan(spark, path, bbox, limit).where(F.size("ring") >= 3).withColumn("p", profile)
    return rows.select("file", "at", "ring", F.col("p")[0].alias("height"), F.col("p")[1].alias("k"), F.col("p")[2].alias("k_bare"))


def element_buildings(spark: SparkSession, path: str, bbox: BBox | None = None) -> DataFrame:
    """Building footprints of tagged elements, of a box if given."""
    rows = scan(spark, path, bbox).where(F.size("ring") >= 3)
    height, rough = height_of(first_number(F.element_at("tags", "height")), first_number(F.element_at("tags", "building:levels")))
    lat, lon = ring_centre(F.col("ring"))
    return rows.select("file", "at", "ring", height.alias("height"), rough.alias("approx"), lat.alias("lat"), lon.alias("lon"))


def element_vegetation(spark: SparkSession, path: str, bbox: BBox | None = None) -> tuple[DataFrame, DataFrame]:
    """Trees (nodes) and zones (with a ring) of tagged elements, of a box if given."""
    rows = scan(spark, path, bbox)
    tag = lambda n: F.element_at("tags", n)
    profile = tree_profile(tag("leaf_type"))
    trees = rows.where("kind = 'node'").withColumn("p", profile).select(
        "file", "at", "lat", "lon", F.coalesce(F.nullif(first_number(tag("height")), F.lit(0.0)), "p.height").alias("height"), crown_radius(first_number(tag("diameter_crown")), first_number(tag("circumference"))).alias("radius"), "p.k", "p.k_bare"
    )
    zones = rows.where(F.size("ring") >= 3).select("file", "at", "ring", tag("natural").alias("natural"), tag("landuse").alias("landuse"))
    return trees, zones


def decimal(text: Column) -> Column:
    """A number with a comma or a point; null if it isn't one."""
    return F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")


def delimited(spark: SparkSession, path: str, names: tuple[str, ...], required: int) -> DataFrame:
    """Lines of numbers, separated by semicolons if the line has one, else commas; lines that lack a required number are dropped."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    parts = F.split("value", F.when(F.contains("value", F.lit(";")), ";").otherwise(","))
    rows = lines.withColumn("p", parts).select("file", "line", *[decimal(F.get("p", F.lit(i))).alias(n) for i, n in enumerate(names)])
    kept = rows.dropna(subset=list(names[:required]))
    return kept.withColumn("seq", (F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1).cast("int")).drop("file", "line")


def weather_text(spark: SparkSession, path: str) -> DataFrame:
    """Five required channels, then wind and hour index if given."""
    return delimited(spark, path, ("t_ext", "sun_azimuth", "sun_elevation", "e_dir", "e_dif", "wind_m_s", "hour_index"), 5)


def wall_weather_text(spark: SparkSession, path: str) -> DataFrame:
    """The five channels of a wall run."""
    return delimited(spark, path, ("t_ext", "h_s", "theta_i", "e_dir", "e_dif"), 5)


def schedule_text(spark: SparkSession, path: str) -> DataFrame:
    """Exactly 24 lines of flow, recovery, gains and shutter flag; any other number is an error."""
    rows = delimited(spark, path, ("debit", "eta", "gains", "flag"), 3)
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    checked = rows.crossJoin(F.broadcast(n)).where(F.assert_true(F.col("n") == 24, F.lit("a schedule has 24 lines")).isNull())
    return checked.select(F.col("seq").alias("slot"), "debit", "eta", "gains", (F.coalesce("flag", F.lit(0.0)) != 0).alias("shut"))


def obj_triangles(spark: SparkSession, path: str) -> DataFrame:
    """Triangles of OBJ files (each with vertices of its own; tri_id counts within the file) with the group in force; faces of more corners are cut into fans."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    w = Window.partitionBy("file").orderBy("line")
    words = F.split(F.trim("value"), r"\s+")
    named = lines.select("file", "line", words.alias("w")).withColumn("grp", F.last_value(F.when(F.col("w")[0].isin("g", "o"), F.get("w", F.lit(1))), F.lit(True)).over(w))
    vertices = named.where("w[0] = 'v'").select("file", (F.row_number().over(w)).alias("vid"), *[F.col("w")[i + 1].try_cast("double").alias(c) for i, c in enumerate("xyz")])
    index = lambda s: F.split(s, "/")[0].cast("int")
    faces = named.where("w[0] = 'f'").select("file", "line", "grp", F.transform(F.slice("w", 2, F.size("w")), index).alias("v"))
    fans = faces.select("file", "line", "grp", F.posexplode(F.transform(F.sequence(F.lit(2), F.size("v") - 1), lambda i: F.struct(F.get("v", F.lit(0)).alias("a"), F.get("v", i - 1).alias("b"), F.get("v", i).alias("c")))).alias("fan", "t"))
    out = fans.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("line", "fan")) - 1).alias("tri_id"), F.coalesce("grp", F.lit("groupe_1")).alias("grp"), "t.a", "t.b", "t.c")
    for i, c in enumerate("abc"):
        out = out.join(vertices.select("file", F.col("vid").alias(c), *[F.col(x).alias(f"{x}{i}") for x in "xyz"]), ["file", c])
    return out.drop("a", "b", "c")


MESH_READERS = {"obj": obj_triangles, "stl": stl.triangles}


def mesh_file(spark: SparkSession, path: str) -> DataFrame:
    """Triangles of a mesh file by its extension."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in MESH_READERS:
        raise ValueError(f"no reader for .{kind} meshes")
    return MESH_READERS[kind](spark, path)


def altitudes(points: DataFrame, primary: DataFrame, secondary: DataFrame | None, keys: tuple[str, ...], most: int = 60) -> DataFrame:
    """Points in their own order with ``altitude`` and the number of the request each would go in (``most`` points apiece).

    If the first source lacks any point, the second answers for all, as one whose
    answer has another length than the question can't be trusted.
    """
    numbered = points.withColumn("batch", F.floor(F.col("seq") / most).cast("int"))
    found = looked_up(numbered, primary, keys, "altitude")
    if secondary is not None and found.where("altitude is null").limit(1).count():
        return looked_up(numbered, secondary, keys, "altitude")
    return found


def looked_up(points: DataFrame, table: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """Points in their own order with a looked-up value; null where the table has none (offsets, terrain heights)."""
    return points.join(table.select(*keys, value), list(keys), "left")
