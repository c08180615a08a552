"""Queries on entity tables: changes, checks of rows and gates before a run, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from calorix.functions import display
from calorix.functions.rounding import tidy
from calorix.operators import constraints, entities
from calorix.sources.tables import Warehouse, with_views


def members(w: Warehouse):
    return w.table("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("department_id"))


def entity_changes(spark, sf_dir):
    """Members after a partial update, an insert of those absent and the removal of a department."""
    w = Warehouse(spark, sf_dir)
    current = members(w)
    changes = current.where("id % 3 = 0").select("id", F.lower("name").alias("name"), F.lit(None).cast("long").alias("department_id"))
    added = spark.range(20, 30).select("id", F.concat(F.lit("new "), F.col("id").cast("string")).alias("name"), (F.col("id") % 5).alias("department_id"))
    all_ = entities.inserted_if_absent(entities.partly_updated(current, changes, "id"), added, "id")
    departments = w.table("region").select(F.col("r_regionkey").cast("long").alias("department_id"), "r_name")
    _, freed = entities.deleted_with_null(departments, all_, departments.where("department_id = 2"), "department_id")
    return freed.select("id", "name", F.coalesce("department_id", F.lit(-1)).alias("department_id"))


def taken_names(spark, sf_dir):
    """Rows whose name another member has, and the departments that members refer to but don't exist."""
    current = members(Warehouse(spark, sf_dir))
    rows = current.select((F.col("id") + F.when(F.col("id") % 2 == 0, 0).otherwise(100)).alias("id"), "name")
    return entities.taken_names(rows, current).select("id", "name")


def unknown_departments(spark, sf_dir):
    """The sorted departments that members refer to but that a shorter table lacks."""
    w = Warehouse(spark, sf_dir)
    known = w.table("region").where("r_regionkey < 3").select(F.col("r_regionkey").cast("long").alias("department_id"))
    return entities.unknown_references(members(w), known, "department_id").select(F.array_join(F.col("unknown").cast("array<string>"), ",").alias("unknown"))


def row_checks(spark, sf_dir):
    """Checks of sample requests: both or neither frame value, its share, the date window, the mode's fields, the order of setpoints, hourly bounds."""
    k = F.col("cand_id")
    start = F.date_add(F.lit("2024-01-01").cast("date"), (k % 500).cast("int"))
    rows = Warehouse(spark, sf_dir).candidates().select(
        "cand_id", F.when(k % 3 != 0, 1.8).alias("frame_u"), F.when(k % 4 != 0, (k % 7) / 6.0).alias("frame_fraction"), start.alias("start"), F.date_add(start, ((k * 7) % 800 - 200).cast("int")).alias("end"),
        F.element_at(F.array(*map(F.lit, ("imposed", "free", "thermostat", "other"))), (k % 4 + 1).cast("int")).alias("mode"), F.when(k % 5 != 0, 20.0).alias("t_int"), F.when(k % 7 != 0, 1e5).alias("c_air_int"),
        (18.0 + k % 5).alias("t_min"), F.when(k % 6 != 0, 20.0).alias("t_max"), ((k % 90) - 20.0).alias("t_ext"), (k % 400).cast("double").alias("sun_azimuth"), ((k % 100) - 5.0).alias("sun_elevation"), (k % 1600).cast("double").alias("e_dir"), F.lit(5.0).alias("e_dif"),
    )
    return rows.select(
        "cand_id", entities.co_null("frame_u", "frame_fraction").alias("frame_pair"), constraints.frame_share_ok().alias("frame_share"), entities.window_ok("start", "end").alias("window"), F.coalesce(constraints.mode_ok(), F.lit(False)).alias("mode_fields"),
        F.coalesce(constraints.ordered_setpoints(), F.lit(False)).alias("ordered"), constraints.weather_ok().alias("weather"),
    )


def run_gates(spark, sf_dir):
    """Gates before a run: triangles without a wall, buildings with fresh visibility, busy jobs by kind, hours without wind, work over its caps."""
    w = Warehouse(spark, sf_dir)
    walls = w.layers().where("wall_id % 2 = 0").select("wall_id").distinct()
    triangles = w.triangles().join(walls.withColumn("known", F.lit(True)), "wall_id", "left").withColumn("wall_id", F.when(F.col("known"), F.col("wall_id")))
    bare = constraints.unassigned(triangles)
    buildings = w.sites().select(F.col("site_id").alias("building_id"), (F.col("site_id") % 4).cast("string").alias("version"))
    fresh = constraints.fresh(buildings, buildings.withColumn("version", F.when(F.col("building_id") % 3 == 0, "9").otherwise(F.col("version")))).agg(F.count(F.lit(1)).alias("n_fresh"))
    jobs = w.sites().select(F.when(F.col("site_id") == 7, "RUNNING").otherwise("DONE").alias("status"), F.lit("simulation").alias("kind"))
    idle, other = constraints.free_of_jobs(jobs).withColumnRenamed("free", "idle"), constraints.free_of_jobs(jobs, "visibility").withColumnRenamed("free", "idle_visibility")
    hours = w.weather_raw().select(F.hour("hour_ts").alias("seq"), "wind_raw")
    wind = constraints.all_have(hours, "wind_raw")
    over = constraints.work(w.triangles().agg(F.count(F.lit(1)).alias("triangles"), F.lit(24).alias("hours"))).select(F.col("over"))
    out = bare
    for one in (fresh, idle, other, wind, over):  # one row each
        out = out.crossJoin(F.broadcast(one))
    return out


def latest_events(spark, sf_dir):
    """Every user's last event, and what 12.5 m3 of air for each of its numbers holds."""
    events = Warehouse(spark, sf_dir).table("events").select("user_id", "event_id", "event_type")
    return entities.latest_per(events, "user_id", "event_id").select("user_id", "event_id", "event_type", tidy(display.air_capacity(F.col("user_id") * 12.5), 3).alias("capacity"))


QUERIES = {f.__name__: f for f in (entity_changes, taken_names, unknown_departments, row_checks, run_gates, latest_events)}
ORACLES = {
    "entity_changes": """WITH m AS (SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) ELSE n_name END AS name, CAST(n_regionkey AS BIGINT) AS department_id FROM nation),
        a AS (SELECT * FROM m UNION ALL SELECT i, 'new ' || i, i % 5 FROM range(20, 30) t(i) WHERE i NOT IN (SELECT id FROM m)) SELECT id, name, CASE WHEN department_id = 2 THEN -1 ELSE department_id END AS department_id FROM a""",
    "taken_names": "SELECT CAST(n_nationkey + 100 AS BIGINT) AS id, n_name AS name FROM nation WHERE n_nationkey % 2 = 1",
    "unknown_departments": "SELECT string_agg(k, ',' ORDER BY k) AS unknown FROM (SELECT DISTINCT n_regionkey AS k FROM nation WHERE n_regionkey >= 3)",
    "row_checks": with_views(
        """WITH r AS (SELECT cand_id AS k, DATE '2024-01-01' + CAST(cand_id % 500 AS INT) AS s, CAST((cand_id * 7) % 800 - 200 AS INT) AS d FROM v5)
        SELECT k AS cand_id, (k % 3 = 0) = (k % 4 = 0) AS frame_pair, k % 4 = 0 OR (k % 7) / 6e0 < 1 AS frame_share, d BETWEEN 0 AND 366 AS window,
        CASE k % 4 WHEN 0 THEN k % 5 <> 0 WHEN 1 THEN k % 7 <> 0 WHEN 2 THEN k % 7 <> 0 AND k % 6 <> 0 ELSE false END AS mode_fields, k % 6 <> 0 AND 18 + k % 5 < 20 AS ordered,
        (k % 90) - 20 BETWEEN -60 AND 60 AND k % 400 <= 360 AND (k % 100) - 5 <= 90 AND k % 1600 <= 1400 AS weather FROM r""", "v5"),
    "run_gates": with_views(
        """WITH t AS (SELECT count(*) AS n, count(*) FILTER (WHERE wall_id NOT IN (SELECT wall_id FROM v3 WHERE wall_id % 2 = 0)) AS bare FROM v4), h AS (SELECT hour(hour_ts) AS seq FROM v1 WHERE wind_raw IS NULL)
        SELECT bare AS n_unassigned, (SELECT count(*) FROM v2 WHERE site_id % 3 <> 0) AS n_fresh, (SELECT count(*) FROM v2 WHERE site_id = 7) = 0 AS idle, true AS idle_visibility,
        (SELECT count(*) FROM h) AS n_missing, (SELECT CAST(min(seq) AS INT) FROM h) AS first_missing, CASE WHEN n > 20000 THEN 'triangles' ELSE '' END AS over FROM t""", "v1", "v2", "v3", "v4"),
    "latest_events": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, round(1200e0 * (user_id * 12.5e0), 3) + 0e0 AS capacity FROM events GROUP BY user_id",
}
