"""Stored results that are recomputed where their content has changed, and nowhere else.

A group's version is a digest of its rows whatever their order.  The store is Parquet
in buckets of keys; a refresh compares versions, computes the stale groups alone and
overwrites only the buckets that hold a stale or vanished one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calorix.sources.stage import written

BUCKETS = 64
#: Changed keys up to which they are broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_KEYS = 500_000


def versions(items: DataFrame, key: str) -> DataFrame:
    """key and version: number of rows and two sums over their hashes, so that repeated rows count."""
    row = F.struct(*sorted(items.columns))
    # Halves of hashes, whose sums stay far from a long's end.
    halves = [F.sum(h) for seed in (1, 2) for h in (F.shiftright(F.xxhash64(row, F.lit(seed)), 32), F.xxhash64(row, F.lit(seed)).bitwiseAND(F.lit(0xFFFFFFFF)))]
    return items.groupBy(key).agg(F.md5(F.concat_ws(":", F.count(F.lit(1)), *halves)).alias("version"))


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored results, none before the first refresh."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root)
    return spark.read.parquet(path) if there else None


def refresh(items: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], path: str, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """The results of all groups after a refresh, and the keys that were computed.

    ``compute`` takes the stale groups' items and returns rows with the key; a group
    without results is kept as a key that is up to date.
    """
    spark = items.sparkSession
    bucket = F.pmod(F.hash(key), F.lit(buckets)).alias("bucket")
    before, now = stored(spark, path), versions(items, key)
    replace = lambda rows: rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    if before is None:
        # All are stale: nothing is looked up, and the store is written at once.
        now = written(now, "versions")
        known = now.where(F.col(key).isNotNull())
        if not known.isEmpty():
            replace(known.join(compute(items), key, "left").withColumn("bucket", bucket))
        stale = now.select(key)
    else:
        old = before.select(F.col(key).alias("__key"), F.col("version").alias("__version")).distinct()
        both = now.withColumn("__here", F.lit(True)).join(old, now[key].eqNullSafe(F.col("__key")), "full")
        differ = both.where("__here is null or not (version <=> __version)").select(F.coalesce(key, "__key").alias(key), "version", F.col("__here").isNotNull().alias("__here"))
        changed = written(differ.withColumn("bucket", bucket), "changed")
        few = F.broadcast if changed.count() <= BROADCAST_KEYS else lambda rows: rows
        stale = changed.where("__here").select(key)
        touched = changed.where(F.col(key).isNotNull()).select("bucket").distinct()
        if not touched.isEmpty():
            fresh = compute(items.join(few(stale), key, "left_semi"))
            rows = changed.where(F.col("__here") & F.col(key).isNotNull()).drop("__here").join(fresh, key, "left")
            # The other groups of these buckets go with them, unless they vanished.
            kept = before.join(F.broadcast(touched), "bucket", "left_semi").join(few(changed.select(key)), key, "left_anti")
            rows = written(rows.unionByName(kept), "refreshed")
            replace(rows)
            emptied = [r["bucket"] for r in touched.join(rows.select("bucket").distinct(), "bucket", "left_anti").collect()]  # of BUCKETS at most
            for b in emptied:
                root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={b}")
                root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)
    return spark.read.parquet(path).drop("bucket", "version"), stale
