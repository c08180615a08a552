"""Checks before a run: bounds, presence, references, work caps.

Each gives a predicate or a one-row verdict; ``enforced`` turns a verdict into an
error, ``entities.split_by`` into accepted and rejected rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calorix.operators.entities import required_by_mode

# Inclusive bounds of hourly weather, openings and schedules.
WEATHER_BOUNDS = {"t_ext": (-60.0, 60.0), "sun_azimuth": (0.0, 360.0), "sun_elevation": (-90.0, 90.0), "e_dir": (0.0, 1400.0), "e_dif": (0.0, 600.0)}
# Most unknowns, hours, real-time ray tests, boundary combinations, nodes of a wall, vertices and triangles of a mesh.
CAPS = {"unknowns": 60_000, "hours": 8784, "rays": 2_000_000, "combinations": 2000, "nodes": 300, "vertices": 20_000, "triangles": 20_000}
# Fields that each mode of the inner side needs.
MODE_FIELDS = {"imposed": ("t_int",), "free": ("c_air_int",), "thermostat": ("c_air_int", "t_min", "t_max")}


def within(bounds: dict[str, tuple[float, float]]) -> Column:
    """All given fields are within their bounds; null fails."""
    ok = F.lit(True)
    for name, (low, high) in bounds.items():
        ok = ok & F.coalesce(F.col(name).between(low, high), F.lit(False))
    return ok


def weather_ok() -> Column:
    """All channels of an hour are within their bounds."""
    return within(WEATHER_BOUNDS)


def mode_ok(mode: str = "mode") -> Column:
    """The fields that a run's mode needs are there."""
    return required_by_mode(mode, MODE_FIELDS)


def ordered_setpoints(low: str = "t_min", high: str = "t_max") -> Column:
    return F.col(low) < F.col(high)


def frame_share_ok(share: str = "frame_fraction") -> Column:
    return F.col(share).isNull() | (F.col(share) >= 0) & (F.col(share) < 1)


def all_have(rows: DataFrame, field: str, order: str = "seq") -> DataFrame:
    """One row: how many lack the field, and the first that does."""
    gone = F.col(field).isNull()
    return rows.agg(F.count_if(gone).alias("n_missing"), F.min(F.when(gone, F.col(order))).alias("first_missing"))


def bad_corners(faces: DataFrame, n_vertices: int) -> DataFrame:
    """Faces that name a vertex out of range."""
    ok = F.lit(True)
    for c in ("v0", "v1", "v2"):
        ok = ok & F.coalesce(F.col(c).between(0, n_vertices - 1), F.lit(False))
    return faces.where(~ok)


def work(counts: DataFrame, caps: dict[str, int] = CAPS) -> DataFrame:
    """Counts with the names of the caps they pass."""
    over = [F.when(F.col(c) > caps[c], F.lit(c)) for c in counts.columns if c in caps]
    return counts.withColumn("over", F.concat_ws(",", *over))


def enforced(rows: DataFrame, ok: Column, message: str) -> DataFrame:
    """The rows, or an error at the first one that isn't ok."""
    return rows.where(F.assert_true(F.coalesce(ok, F.lit(False)), F.lit(message)).isNull())


def unassigned(triangles: DataFrame, wall: str = "wall_id") -> DataFrame:
    """One row: triangles without a wall."""
    return triangles.agg(F.count_if(F.col(wall).isNull()).alias("n_unassigned"))


def fresh(buildings: DataFrame, cubes: DataFrame, key: str = "building_id", version: str = "version") -> DataFrame:
    """Buildings whose stored visibility has their mesh's version."""
    return buildings.join(cubes.select(key, version), [key, version], "left_semi")


def free_of_jobs(jobs: DataFrame, kind: str | None = None) -> DataFrame:
    """One row: whether no job (of the kind) is waiting or running."""
    busy = F.col("status").isin("PENDING", "RUNNING")
    return jobs.agg((F.count_if(busy & (F.col("kind") == kind) if kind else busy) == 0).alias("free"))


def content_version(triangles: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """A version per mesh that changes with any of the columns and not with the order of rows."""
    return triangles.groupBy(by).agg(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string").alias("version"))
