"""Surroundings of a building as meshes: neighbours, obstacles, vegetation, terrain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calorix.functions import geodesy
from calorix.operators import footprints, meshes, places, polygons
from calorix.sources.readers import ring_centre
from calorix.sources.stage import written

MAX_VEGETATION = 400
SIZES, CAPS = ("n_vertices", "n_triangles"), (20_000, 20_000)


@dataclass(frozen=True)
class Site:
    """Origin of the local frame and what stands there."""

    lat: float
    lon: float
    north_offset_deg: float = 0.0
    ground_z: float = 0.0
    study: polygons.Shape | None = None


def local_ring(ring: Column, site: Site) -> Column:
    """A ring of (lat, lon) in the site's frame."""

    def place(p: Column) -> Column:
        x, y = geodesy.project(p["lat"], p["lon"], F.lit(site.lat), F.lit(site.lon))
        return footprints.point(*geodesy.rotate(x, y, F.lit(site.north_offset_deg)))

    return F.transform(ring, place)


def located(items: DataFrame, site: Site) -> DataFrame:
    """Items (with ``ring`` of lat and lon) with their ring in the site's frame and the distance of its centre."""
    lat, lon = ring_centre(F.col("ring"))
    x, y = geodesy.project(lat, lon, F.lit(site.lat), F.lit(site.lon))
    return items.withColumn("dist", F.hypot(x, y)).withColumn("ring", local_ring(F.col("ring"), site))


def based(items: DataFrame, lookup: DataFrame | None, site: Site) -> DataFrame:
    """Items with ``base``: altitude over the site's ground, their own, else looked up, else 0."""
    if lookup is None:
        lookup = items.select("item").where("false").withColumn("altitude", F.lit(None).cast("double"))
    return places.base_altitudes(items, lookup, site.ground_z, "item").withColumnRenamed("base_rel", "base")


def built(items: DataFrame, site: Site) -> DataFrame:
    """Located items resolved against the study polygon and extruded, with the sizes of their meshes."""
    solid = polygons.extruded_parts(polygons.resolved(items, site.study))
    return written(solid.withColumns({"n_vertices": polygons.corner_count(F.col("parts")), "n_triangles": F.size("faces")}), "built")


def faces_of(kept: DataFrame, *also: str) -> DataFrame:
    """One row per triangle of the admitted items, numbered on across items."""
    rows = kept.select("item", "n_triangles_offset", *also, F.posexplode("faces").alias("__face", "f"))
    return rows.select("item", *also, (F.col("n_triangles_offset") + F.col("__face")).alias("tri_id"), "f.*")


def environment(items: DataFrame, site: Site, lookup: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Obstacle triangles around a site, and one row of counts.

    items: (item, ring of lat and lon, height, approx, source) and base_z where
    known.  The nearest come first; one that is the study building itself is left
    out, one that overlaps it is clipped; at the first that would pass a cap it ends.
    """
    found = built(based(located(items, site), lookup, site), site)
    kept = places.admitted(found.where("status in ('kept', 'clipped')"), SIZES, CAPS, ("dist", "item"))
    kept = written(kept, "admitted")
    marked = found.select("item", "status", "source", "approx").join(kept.select("item", F.lit(True).alias("used")), "item", "left").withColumn("used", F.coalesce("used", F.lit(False)))
    sources = marked.agg(F.count_if(F.col("source") == "ign").alias("n_ign"), F.count_if(F.col("source") == "osm").alias("n_osm"), F.count_if(F.col("used") & F.col("approx")).alias("n_approx"))
    return faces_of(kept), places.source_stats(marked).crossJoin(sources)


def vegetation(zones: DataFrame, trees: DataFrame, other_zones: DataFrame, site: Site, lookup: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """See-through triangles around a site, each with its object's number and transmittance, and one row of counts.

    zones: (item, ring, height, k); trees: (item, lat, lon, radius, height, k).  The
    sources add up; of the second one's zones only those abroad count.  All parts of
    an element are one object; beyond the nearest 400 none is looked at.
    """
    inside = geodesy.in_country(F.lit(site.lat), F.lit(site.lon))
    areas = located(places.accumulated(zones, zones.where("false"), other_zones, inside), site)
    x, y = geodesy.project(F.col("lat"), F.col("lon"), F.lit(site.lat), F.lit(site.lon))
    cx, cy = geodesy.rotate(x, y, F.lit(site.north_offset_deg))
    crowns = trees.select("item", footprints.crown(cx, cy, F.col("radius")).alias("ring"), "height", "k", F.hypot(x, y).alias("dist"))
    objects = areas.select("item", "ring", "height", "k", "dist").unionByName(crowns)
    nearest = places.nearest(objects, MAX_VEGETATION, ("dist", "item")).withColumn("base_z", F.lit(None).cast("double"))
    found = built(based(nearest, lookup, site), site)
    kept = written(places.admitted(found.where("status in ('kept', 'clipped')"), SIZES, CAPS, ("dist", "item")), "admitted")
    # At most MAX_VEGETATION rows are numbered.
    numbered = kept.withColumn("obj", F.row_number().over(Window.orderBy("dist", "item")) - 1)
    stats = objects.agg(F.count(F.lit(1)).alias("n_total")).crossJoin(kept.agg(F.count(F.lit(1)).alias("n_used"))).withColumn("n_skipped", F.col("n_total") - F.col("n_used"))
    return faces_of(numbered, "obj", "k"), stats


def nearby(sites: DataFrame, buildings: DataFrame, radius_m: float, most_walls: int = 30, k: int = 5) -> DataFrame:
    """Per site the k nearest buildings of its box that aren't too complex, with their extruded faces and how many nearer ones were.

    buildings: (cand_id, lat, lon, ring of x and y in metres, height); a building has a wall for each side of its ring.
    """
    solid = polygons.extruded_parts(polygons.resolved(buildings).withColumn("base", F.lit(0.0)))
    walled = solid.withColumn("n_walls", wall_groups(F.col("faces")))
    found = places.nearest_in_boxes(sites.select("site_id", "lat", "lon"), walled.select("cand_id", "lat", "lon", "n_walls"), radius_m, F.col("n_walls") <= most_walls, k, "cand_id")
    return found.join(walled.select("cand_id", "faces"), "cand_id")


def wall_groups(faces: Column) -> Column:
    """Number of distinct groups of walls."""
    names = F.transform(faces, lambda f: F.concat_ws(":", f["part"], f["grp"]))
    return F.size(F.array_distinct(F.filter(names, lambda n: n.contains(":mur_"))))


def terrain(spark: SparkSession, site: Site, altitudes: DataFrame, radius: float, step: float) -> tuple[DataFrame, DataFrame]:
    """Terrain points (vid, x, y, z) and faces around a site; level under the study polygon.

    altitudes: (vid, altitude), one for each grid point, else it is an error.
    """
    grid, faces = meshes.terrain(spark, radius, step)
    if altitudes.count() != grid.count() or grid.join(altitudes, "vid", "left_anti").count():
        raise ValueError("there must be one altitude for each grid point")
    under = F.lit(False)
    for ring in site.study or []:
        under = under != meshes.inside_ring(F.col("x"), F.col("y"), ring)
    z = F.when(under, 0.0).otherwise(F.col("altitude") - site.ground_z)
    return grid.join(altitudes, "vid").select("vid", "x", "y", z.alias("z")), faces


def grid_places(spark: SparkSession, site: Site, radius: float, step: float) -> DataFrame:
    """The terrain grid's points as (vid, lat, lon), to look altitudes up."""
    grid, _ = meshes.terrain(spark, radius, step)
    x, y = geodesy.rotate(F.col("x"), F.col("y"), F.lit(-site.north_offset_deg))
    lat, lon = geodesy.unproject(x, y, F.lit(site.lat), F.lit(site.lon))
    return grid.select("vid", lat.alias("lat"), lon.alias("lon"))
