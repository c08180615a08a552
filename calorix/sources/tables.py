"""Typed domain views over the warehouse tables (star schema and event stream).

They bind weather, sites, walls, triangles, candidates, obstacles, calendar and
schedule to columns of the warehouse, with only the columns that are needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Warehouse:
    """Tables of one directory and the domain views over them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def weather_raw(self) -> DataFrame:
        """One row per hour; channels without an observation are null."""
        of = lambda kind: F.when(F.col("event_type") == kind, F.col("value"))
        return (
            self.table("events")
            .groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour_ts"))
            .agg(
                F.round(F.avg(of("view")) - 40.0, 6).alias("t_ext_raw"),
                F.round(F.sum(of("purchase")) * 8.0, 6).alias("e_dir_raw"),
                F.round(F.avg(of("click")) * 4.0, 6).alias("e_dif_raw"),
                F.round(F.avg(of("error")) / 10.0, 6).alias("wind_raw"),
            )
        )

    def sites(self) -> DataFrame:
        k = F.col("s_suppkey")
        lattice = lambda a, n, off: ((k * a) % n - off).cast("double")
        return self.table("supplier").select(k.alias("site_id"), lattice(37, 120, 60).alias("lat"), lattice(53, 360, 180).alias("lon"), lattice(17, 360, 0).alias("north_offset_deg"))

    def layers(self) -> DataFrame:
        k, wall = F.col("p_partkey"), F.floor(F.col("p_partkey") / 4.0)
        glazed = wall % 5 == 0
        return self.table("part").select(
            wall.cast("long").alias("wall_id"),
            (k % 4).cast("int").alias("layer_idx"),
            (0.005 + F.col("p_size") / 200.0).alias("e"),
            (0.03 + ((k * 7) % 100) / 50.0).alias("lam"),
            (20.0 + 2.0 * F.col("p_retailprice")).alias("rho"),
            (750 + (k * 13) % 1000).cast("double").alias("c"),
            F.when(glazed, 0.8).otherwise(0.0).alias("tau"),
            F.lit(0.1).alias("r"),
            F.when(glazed, 0.1).otherwise(0.9).alias("alpha"),
        )

    def triangles(self) -> DataFrame:
        x, y, z = F.col("l_quantity"), F.col("l_discount") * 100.0, F.col("l_tax") * 100.0 + 0.0
        flat = F.col("l_partkey") % 97 == 0
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("mesh_id"),
            F.col("l_linenumber").alias("tri_id"),
            x.alias("x0"), y.alias("y0"), z.alias("z0"),
            (x + 1.0 + F.col("l_partkey") % 7).alias("x1"), (y + F.col("l_suppkey") % 3).alias("y1"), z.alias("z1"),
            x.alias("x2"), F.when(flat, y).otherwise(y + 1.0).alias("y2"), F.when(flat, z).otherwise(z + (F.col("l_partkey") % 5).cast("double") - 2.0).alias("z2"),
            F.col("l_returnflag").alias("grp"),
            F.floor(F.col("l_partkey") / 4.0).cast("long").alias("wall_id"),
            F.when(F.col("l_linestatus") == "F", "ground").otherwise("exterior_air").alias("boundary"),
        )

    def candidates(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(
            k.alias("cand_id"),
            (((k * 37) % 120 - 60).cast("double") + ((k * 29) % 1000) / 1000.0).alias("lat"),
            (((k * 53) % 360 - 180).cast("double") + ((k * 31) % 1000) / 1000.0).alias("lon"),
            (4 + k % 60).cast("int").alias("n_walls"),
            F.when(F.col("c_acctbal") < 0, "osm").otherwise("ign").alias("source"),
        )

    def obstacles(self) -> DataFrame:
        k = F.col("n_nationkey")
        return self.table("nation").select(
            k.alias("obj"), (k % 5 * 4 - 10).cast("double").alias("cx"), (F.col("n_regionkey") * 4 - 10).cast("double").alias("cy"), (5.0 + k).alias("cz"), F.when(k % 3 == 0, 0.25).alias("k")
        )

    def days(self) -> DataFrame:
        return self.table("orders").select(F.to_date("o_orderdate").alias("d")).distinct()

    def schedule(self) -> DataFrame:
        nation = self.table("nation").where("n_nationkey < 5").select(F.col("n_nationkey").alias("k"))
        slot = F.col("r_regionkey") * 5 + F.col("k")
        return (
            self.table("region").crossJoin(nation).where(slot < 24).select(
                slot.cast("int").alias("slot"),
                (30 + 10 * (slot % 3)).cast("double").alias("debit"),
                (0.1 * (slot % 4)).alias("eta"),
                (50 * (slot % 5)).cast("double").alias("gains"),
                (slot < 7).alias("shut"),
            )
        )


#: The same views as DuckDB SQL, for the oracles.
VIEW_SQL = {
    "v1": """SELECT date_trunc('hour', ts) AS hour_ts, round(avg(CASE WHEN event_type='view' THEN value END)-40e0,6) AS t_ext_raw,
      round(sum(CASE WHEN event_type='purchase' THEN value END)*8e0,6) AS e_dir_raw, round(avg(CASE WHEN event_type='click' THEN value END)*4e0,6) AS e_dif_raw,
      round(avg(CASE WHEN event_type='error' THEN value END)/10e0,6) AS wind_raw FROM events GROUP BY 1""",
    "v2": """SELECT s_suppkey AS site_id, CAST((s_suppkey*37)%120-60 AS DOUBLE) AS lat, CAST((s_suppkey*53)%360-180 AS DOUBLE) AS lon,
      CAST((s_suppkey*17)%360 AS DOUBLE) AS north_offset_deg FROM supplier""",
    "v3": """SELECT CAST(floor(p_partkey/4e0) AS BIGINT) AS wall_id, CAST(p_partkey%4 AS INT) AS layer_idx, 0.005e0+p_size/200e0 AS e,
      0.03e0+((p_partkey*7)%100)/50e0 AS lam, 20e0+2e0*p_retailprice AS rho, CAST(750+(p_partkey*13)%1000 AS DOUBLE) AS c,
      CASE WHEN floor(p_partkey/4e0)%5=0 THEN 0.8e0 ELSE 0e0 END AS tau, 0.1e0 AS r, CASE WHEN floor(p_partkey/4e0)%5=0 THEN 0.1e0 ELSE 0.9e0 END AS alpha FROM part""",
    "v4": """SELECT l_orderkey AS mesh_id, l_linenumber AS tri_id, l_quantity AS x0, l_discount*100e0 AS y0, l_tax*100e0+0e0 AS z0,
      l_quantity+1e0+(l_partkey%7) AS x1, l_discount*100e0+(l_suppkey%3) AS y1, l_tax*100e0+0e0 AS z1, l_quantity AS x2,
      CASE WHEN l_partkey%97=0 THEN l_discount*100e0 ELSE l_discount*100e0+1e0 END AS y2,
      CASE WHEN l_partkey%97=0 THEN l_tax*100e0+0e0 ELSE l_tax*100e0+0e0+CAST(l_partkey%5 AS DOUBLE)-2e0 END AS z2,
      l_returnflag AS grp, CAST(floor(l_partkey/4e0) AS BIGINT) AS wall_id, CASE WHEN l_linestatus='F' THEN 'ground' ELSE 'exterior_air' END AS boundary FROM lineitem""",
    "v5": """SELECT c_custkey AS cand_id, CAST((c_custkey*37)%120-60 AS DOUBLE)+((c_custkey*29)%1000)/1000e0 AS lat,
      CAST((c_custkey*53)%360-180 AS DOUBLE)+((c_custkey*31)%1000)/1000e0 AS lon, CAST(4+c_custkey%60 AS INT) AS n_walls,
      CASE WHEN c_acctbal<0 THEN 'osm' ELSE 'ign' END AS source FROM customer""",
    "v6": """SELECT n_nationkey AS obj, CAST(n_nationkey%5*4-10 AS DOUBLE) AS cx, CAST(n_regionkey*4-10 AS DOUBLE) AS cy, 5e0+n_nationkey AS cz,
      CASE WHEN n_nationkey%3=0 THEN 0.25e0 END AS k FROM nation""",
    "v7": "SELECT DISTINCT CAST(date_trunc('day', o_orderdate) AS DATE) AS d FROM orders",
    "v8": """SELECT CAST(r.r_regionkey*5+n.k AS INT) AS slot, CAST(30+10*((r.r_regionkey*5+n.k)%3) AS DOUBLE) AS debit, 0.1e0*((r.r_regionkey*5+n.k)%4) AS eta,
      CAST(50*((r.r_regionkey*5+n.k)%5) AS DOUBLE) AS gains, (r.r_regionkey*5+n.k)<7 AS shut
      FROM region r CROSS JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey<5) n WHERE r.r_regionkey*5+n.k<24""",
}


def with_views(sql: str, *names: str, recursive: bool = False) -> str:
    """SQL with the named views in front of it; SQL that starts with WITH adds its own common tables."""
    views = ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in names)
    rest = sql.strip()
    return f"WITH {'RECURSIVE ' * recursive}{views}{',' if rest.upper().startswith('WITH ') else ''}\n{rest[5:] if rest.upper().startswith('WITH ') else rest}"
