"""Changes to entity tables as DataFrame rewrites, and the checks before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def partly_updated(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with the changes' values where given; what a change leaves null keeps its value."""
    fields = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in fields])
    return current.join(new, key, "left").select(key, *[(F.coalesce(f"__{c}", c) if c in fields else F.col(c)).alias(c) for c in current.columns if c != key])


def inserted_if_absent(current: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with those rows whose key it lacks; of new rows with one key, any one."""
    return current.unionByName(rows.join(current, key, "left_anti").dropDuplicates([key]), allowMissingColumns=True)


def stale_after(buildings: DataFrame, changed_environments: DataFrame) -> DataFrame:
    """Buildings of environments whose geometry changed become stale."""
    changed = changed_environments.select("environment_id").distinct().withColumn("__changed", F.lit(True))
    return buildings.join(changed, "environment_id", "left").withColumn("sun_visibility_stale", F.coalesce("__changed", "sun_visibility_stale")).drop("__changed")


def deleted_with_null(parents: DataFrame, children: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Parents without the ids, and children whose reference to them is null."""
    gone = ids.select(key).distinct().withColumn("__gone", F.lit(True))
    left = parents.join(gone, key, "left_anti")
    freed = children.join(gone, key, "left").withColumn(key, F.when(F.col("__gone").isNull(), F.col(key))).drop("__gone")
    return left, freed


def taken_names(rows: DataFrame, current: DataFrame, name: str = "name", key: str = "id") -> DataFrame:
    """Rows whose name another row of the table already has."""
    other = current.select(F.col(name).alias("__name"), F.col(key).alias("__key"))
    clash = rows[name].eqNullSafe(F.col("__name")) & ~rows[key].eqNullSafe(F.col("__key"))
    return rows.join(other, clash, "left_semi")


def unknown_references(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """One row with the sorted ids that are referred to but unknown."""
    missing = rows.where(F.col(key).isNotNull()).join(known, key, "left_anti")
    return missing.agg(F.array_sort(F.collect_set(key)).alias("unknown"))


def split_by(rows: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """Valid and rejected rows; an unknown verdict rejects."""
    sure = F.coalesce(ok, F.lit(False))
    return rows.where(sure), rows.where(~sure)


def co_null(a: str, b: str) -> Column:
    """Both or neither are given."""
    return F.col(a).isNull() == F.col(b).isNull()


def window_ok(start: str, end: str, most_days: int = 366) -> Column:
    """A date window in order and not too long."""
    return (F.col(start) <= F.col(end)) & (F.datediff(end, start) <= most_days)


def required_by_mode(mode: str, needs: dict[str, tuple[str, ...]]) -> Column:
    """Fields that a row's mode needs are there."""
    ok = F.lit(False)
    for value, fields in needs.items():
        there = F.lit(True)
        for f in fields:
            there = there & F.col(f).isNotNull()
        ok = ok | ((F.col(mode) == value) & there)
    return ok


#: Default order of each table.
ORDERINGS = {"department": ("name",), "user": ("email",), "wall_model": ("name",), "building": ("name",), "environment": ("name",), "job": ("-created_at", "-id")}
#: Fields of a mesh that a partial update may set; others are dropped.
TRIANGLE_FIELDS = ("v", "group", "paroi_model_id", "boundary", "k", "obj")


def listed(rows: DataFrame, kind: str) -> DataFrame:
    """A table in its default order."""
    return rows.orderBy(*[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in ORDERINGS[kind]])


def one(rows: DataFrame, key: str, value) -> DataFrame:
    """The row with this key; it is an error if there is none."""
    found = rows.where(F.col(key) == value).limit(1)
    if not found.count():
        raise LookupError(f"no row with {key} = {value}")
    return found


def with_environments(buildings: DataFrame, environments: DataFrame) -> DataFrame:
    """Buildings, each with its environment's values as ``environment``; null where it has none."""
    fields = [c for c in environments.columns if c != "id"]
    own = environments.select(F.col("id").alias("environment_id"), F.struct(F.col("id"), *fields).alias("environment"))
    return buildings.join(own, "environment_id", "left")


def only_known(triangles: Column, fields: tuple[str, ...] = TRIANGLE_FIELDS) -> Column:
    """An array of triangles with the known fields only."""
    return F.transform(triangles, lambda t: F.struct(*[t[f].alias(f) for f in fields]))


def set_where(rows: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Rows with new values where the condition holds; an unknown condition changes nothing."""
    sure = F.coalesce(condition, F.lit(False))
    return rows.withColumns({c: F.when(sure, v).otherwise(F.col(c)) for c, v in values.items()})


def in_first_order(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Distinct groups by their first appearance."""
    return rows.groupBy(group).agg(F.min(order).alias("first_seen"), F.count(F.lit(1)).alias("n")).orderBy("first_seen")


def saved(results: DataFrame, path: str) -> None:
    """Results as typed Parquet (table) and as one JSON document per row (documents)."""
    results.write.mode("overwrite").parquet(f"{path}/table")
    results.select(F.to_json(F.struct(*results.columns)).alias("value")).write.mode("overwrite").text(f"{path}/documents")


#: Rows that one file for a person may have.
EXPORT_ROWS = 1_000_000


def exported(rows: DataFrame, path: str, order: str) -> None:
    """Semicolon-separated text with a header and two decimals, in one ordered file: for what a person reads; more than EXPORT_ROWS rows are an error."""
    if rows.limit(EXPORT_ROWS + 1).count() > EXPORT_ROWS:
        raise ValueError(f"more than {EXPORT_ROWS} rows: write them as a table")
    text = rows.select(*[F.format_string("%.2f", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes])
    text.orderBy(order).coalesce(1).write.mode("overwrite").option("header", True).option("sep", ";").csv(path)


def newest_first(jobs: DataFrame) -> DataFrame:
    """Jobs by time, the newest first."""
    return jobs.orderBy(F.desc("created_at"), F.desc("id"))


def latest_per(rows: DataFrame, by: str, order: str) -> DataFrame:
    """The last row of each group."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where("__r = 1").drop("__r")
