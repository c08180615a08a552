"""Connected components of an edge table by alternating star contractions.

Every round links each node's larger neighbours to its smallest one, then its
smaller ones too, until nothing changes; the number of rounds grows with the
logarithm of the nodes.  Only minima are gathered per node, so a hub's links are
never brought together; they spread over tasks as a joined (splittable) side.
Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calorix.llm.shared import materialise


def _to_minimum(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair with m, the least of u and its partners."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) for every node of the (u, v) edges; loops only name a node."""
    nodes = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node"))).distinct()
    links = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        met = _to_minimum(large)
        small = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(met.select("u", F.col("m").alias("v"))).distinct()
        links = materialise(small, "links")
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return nodes.join(links.withColumnRenamed("u", "node").withColumnRenamed("v", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
