"""Queries that read files: each writes its fixture from a table to the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from calorix.functions.rounding import tidy
from calorix.sources import boxed, readers
from calorix.sources.stage import folder
from calorix.sources.tables import Warehouse, with_views

#: South, west, north, east of the request.
BOX = (-20.5, -120.5, 25.25, 90.75)


def footprints(w: Warehouse):
    """Candidates as triangles of a hundredth of a degree with their attributes as texts; every fifth has no height, every tenth no storeys."""
    k = F.col("cand_id")
    at = lambda dlat, dlon: F.struct((F.col("lat") + dlat).alias("lat"), (F.col("lon") + dlon).alias("lon"))
    height = F.when(k % 5 > 0, (k % 40 + 2.5).cast("string"))
    storeys = F.when(k % 10 > 0, (k % 7).cast("string"))
    return w.candidates().select(F.create_map(F.lit("cand"), k.cast("string"), F.lit("hauteur"), height, F.lit("nombre_d_etages"), storeys).alias("properties"), F.array(at(0.0, 0.0), at(0.0, 0.01), at(0.01, 0.0)).alias("ring"))


def boxed_buildings(spark, sf_dir):
    """Buildings of a box out of feature collections, the box pushed into the scan."""
    path = folder(spark, "features")
    boxed.write_features(footprints(Warehouse(spark, sf_dir)).repartition(8), path)
    found = readers.feature_buildings(spark, path, limit=None, bbox=BOX)
    return found.select(tidy("lat", 5).alias("lat"), tidy("lon", 5).alias("lon"), tidy("height").alias("height"), "approx")


QUERIES = {f.__name__: f for f in (boxed_buildings,)}
ORACLES = {
    "boxed_buildings": with_views(
        f"""WITH c AS (SELECT cand_id AS k, lat, lon, CASE WHEN cand_id % 5 > 0 THEN cand_id % 40 + 2.5e0 END AS h, CASE WHEN cand_id % 10 > 0 THEN CAST(cand_id % 7 AS DOUBLE) END AS n FROM v5
          WHERE lat <= {BOX[2]}e0 AND lat + 0.01e0 >= {BOX[0]}e0 AND lon <= {BOX[3]}e0 AND lon + 0.01e0 >= {BOX[1]}e0)
        SELECT round(((lat + lat) + (lat + 0.01e0)) / 3e0, 5) + 0e0 AS lat, round(((lon + (lon + 0.01e0)) + lon) / 3e0, 5) + 0e0 AS lon,
          round(coalesce(h, nullif(n, 0e0) * 3e0, 6e0), 6) + 0e0 AS height, h IS NULL AS approx FROM c""", "v5"),
}
