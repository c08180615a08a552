"""Entity tables, positional joins, readers of several files, bounds of plans."""

import glob
import re

import pytest
from pyspark.sql import functions as F

from calorix.functions import display
from calorix.operators import constraints, entities, footprints, meshes, places, visibility, weather
from calorix.plans import weather_queries
from calorix.sources import readers
from calorix.sources.tables import Warehouse

SF = "/root/testdata/sf0.001"


def test_lookup_orderings_and_environments(spark):
    rows = spark.createDataFrame([(1, "b", 10), (2, "a", None)], "id long, name string, environment_id long")
    assert [r["name"] for r in entities.listed(rows, "building").collect()] == ["a", "b"]
    assert entities.one(rows, "id", 2).first()["name"] == "a"
    with pytest.raises(LookupError):
        entities.one(rows, "id", 9)
    environments = spark.createDataFrame([(10, "park")], "id long, name string")
    found = {r["id"]: r["environment"] for r in entities.with_environments(rows, environments).collect()}
    assert found[1]["name"] == "park" and found[2] is None
    jobs = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-02-01")], "id long, created_at string")
    assert [r["id"] for r in entities.listed(jobs, "job").collect()] == [2, 1]


def test_selections_and_partial_updates(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "grp string, wall int")
    assert [r["wall"] for r in entities.set_where(rows, F.col("grp") == "a", {"wall": F.lit(9)}).collect()] == [9, 2, 3]
    mesh = spark.sql("select array(named_struct('v', array(0, 1, 2), 'group', 'g', 'paroi_model_id', 1, 'boundary', 'ground', 'k', null, 'obj', null, 'area', 3.0)) as t")
    assert set(mesh.select(F.inline(entities.only_known(F.col("t")))).columns) == set(entities.TRIANGLE_FIELDS)
    order = spark.createDataFrame([(3, "b"), (1, "c"), (2, "b")], "tri_id int, grp string")
    assert [r["grp"] for r in entities.in_first_order(order, "grp", "tri_id").collect()] == ["c", "b"]


def test_results_are_saved_and_exported(spark, tmp_path):
    rows = spark.createDataFrame([(2, 1.005, "x"), (1, 2.5, "y")], "hour int, t double, note string")
    entities.saved(rows, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r/table")).count() == 2
    assert spark.read.json(str(tmp_path / "r/documents")).where("t = 2.5").count() == 1
    entities.exported(rows, str(tmp_path / "e"), "hour")
    (part,) = glob.glob(str(tmp_path / "e/part-*"))
    assert open(part).read().splitlines() == ["hour;t;note", "1;2.50;y", "2;1.00;x"] or open(part).read().splitlines()[1] == "1;2.50;y"


def test_positional_joins_guard_their_lengths(spark):
    hours, points = spark.range(4).selectExpr("id as seq", "1D as t_min", "'h' as h"), spark.range(4).selectExpr("id as seq", "if(id = 2, null, 5D) as t_min", "9D as t_max")
    assert [(r["t_min"], r["t_max"]) for r in weather.zipped(hours, points).orderBy("seq").collect()] == [(5.0, 9.0), (5.0, 9.0), (1.0, 9.0), (5.0, 9.0)]
    assert weather.zipped(hours, points.limit(3)).columns == hours.columns
    with pytest.raises(ValueError):
        weather.zipped(hours, points.limit(3), strict=True)


def test_schedules_depend_on_each_other(spark):
    slots = spark.range(24).selectExpr("int(id) as slot", "1D as debit")
    with pytest.raises(ValueError):
        weather.with_schedule(spark.range(1), None, slots)
    assert weather.with_schedule(spark.range(3), None).count() == 3


def test_additions_are_whole_and_sources_add_up(spark):
    base, more = spark.sql("select 1 as item, 10 as n"), spark.sql("select 2 as item, 5 as n union all select 3, 5")
    assert places.with_addition(base, more, ("n",), (20,)).count() == 3
    assert places.with_addition(base, more, ("n",), (19,)).count() == 1
    assert places.accumulated(base, more, more, F.lit(True)).count() == 3 and places.accumulated(base, more, more, F.lit(False)).count() == 5
    with pytest.raises(Exception, match="at least 1"):
        places.admitted(spark.sql("select 1 as item, 0 as n"), ("n",), (5,), ("item",)).collect()


def test_boxes_filter_readers_and_files_keep_apart(spark, tmp_path):
    ring = [{"lat": 1.0, "lon": 2.0}, {"lat": 1.1, "lon": 2.0}, {"lat": 1.0, "lon": 2.2}]
    rows = spark.createDataFrame([(ring,)], "ring array<struct<lat:double,lon:double>>")
    for bbox, n in (((0.9, 1.9, 1.05, 2.1), 1), ((1.2, 2.0, 3.0, 3.0), 0), (None, 1)):
        assert rows.where(readers.touches(F.col("ring"), bbox)).count() == n
    for name, z in (("a", 0), ("b", 5)):
        (tmp_path / f"{name}.obj").write_text("g roof\n" + "".join(f"v {x} {y} {z}\n" for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))) + "f 1 2 3 4\n")
    found = readers.obj_triangles(spark, str(tmp_path / "*.obj")).toPandas()
    assert sorted(zip(found["tri_id"], found["z0"])) == [(0, 0.0), (0, 5.0), (1, 0.0), (1, 5.0)]
    fan = "\n".join(f"v {k} {k * k} 0" for k in range(1200)) + "\nf " + " ".join(str(k + 1) for k in range(1200))
    (tmp_path / "wide.obj").write_text(fan)
    assert readers.obj_triangles(spark, str(tmp_path / "wide.obj")).count() == 1198
    for name in "xy":
        (tmp_path / f"{name}.txt").write_text("1;2;3;4;5\n6;7;8;9;10\n")
    assert sorted(r["seq"] for r in readers.wall_weather_text(spark, str(tmp_path / "?.txt")).collect()) == [0, 0, 1, 1]


def test_altitudes_fall_back_as_a_whole(spark):
    points = spark.range(130).selectExpr("id as seq", "id as p")
    full, part = points.selectExpr("p", "p + 0.5D as altitude"), points.where("p > 3").selectExpr("p", "1D as altitude")
    found = readers.altitudes(points, part, full, ("p",)).orderBy("seq").collect()
    assert [r["batch"] for r in found] == [k // 60 for k in range(130)] and found[9]["altitude"] == 9.5
    assert readers.altitudes(points, part, None, ("p",)).where("altitude is null").count() == 4


def test_convex_overlap_turns_and_refuses(spark):
    ring = f"id int, ring array<{footprints.POINT}>"
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    row = spark.createDataFrame([(1, [(1.0, 1.0), (9.0, 1.0), (9.0, 3.0), (1.0, 3.0)])], ring)
    assert footprints.overlaps(row, square[::-1]).first()["overlap"] == pytest.approx(6)
    with pytest.raises(ValueError, match="convex"):
        footprints.overlaps(row, [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 4.0), (0.0, 4.0)])


def test_presentation_values(spark):
    one = spark.range(1)
    r = one.select(display.days_ago(3, F.lit("2024-03-02").cast("date")), display.weather_message(F.lit(24), F.lit("pvgis-tmy"), F.lit("attention"), F.lit(2)), *display.domain(F.lit(None).cast("double"), F.lit(None).cast("double"), 0.08)).first()
    assert r[0] == "2024-02-28" and r[1] == "24 heure(s) récupérée(s) (PVGIS TMY). attention 2 heure(s) ignorée(s), donnée manquante." and tuple(r[2:]) == (0.0, 1.0)
    checked = spark.createDataFrame([(20.0, 10.0, 5.0, 0.0, 0.0, "free", 1.0), (99.0, 10.0, 5.0, 0.0, 0.0, "imposed", None)], "t_ext double, sun_azimuth double, sun_elevation double, e_dir double, e_dif double, mode string, c_air_int double").withColumns({"t_int": F.lit(None), "t_min": F.lit(None), "t_max": F.lit(None)})
    assert [tuple(r) for r in checked.select(constraints.weather_ok(), constraints.mode_ok()).collect()] == [(True, True), (False, False)]


def test_meshes_join_and_gables_close(spark):
    faces = spark.sql("select 0 as v0, 1 as v1, 2 as v2 union all select 1, 2, 3")
    assert sorted(tuple(r) for r in meshes.joined_meshes(faces, faces).collect()) == [(0, 1, 2), (1, 2, 3), (4, 5, 6), (5, 6, 7)]
    t = meshes.gable_box(spark, 10.0, 8.0, 3.0, 2.0).toPandas()
    import numpy as np

    c = t[[f"{x}{i}" for i in range(3) for x in "xyz"]].to_numpy().reshape(-1, 3, 3)
    assert np.einsum("ij,ij->i", c[:, 0], np.cross(c[:, 1], c[:, 2])).sum() / 6 == pytest.approx(10 * 8 * 3 + 0.5 * 8 * 2 * 10)


def test_hourly_visibility_at_exact_angles(spark):
    names = ", ".join(f"{c}{i} double" for i in range(3) for c in "xyz")
    plate = lambda obj, k, z, r: (obj, k, -r, -r, z, r, -r, z, 0.0, 2 * r, z)
    occluders = spark.createDataFrame([plate("a", None, 5.0, 3.0), plate("b", 0.5, 300.0, 500.0)], f"obj string, k double, {names}")
    surface = spark.createDataFrame([(1, 0.0, 0.0, 0.001, 0.0, 0.0, 1.0)], "src int, ox double, oy double, oz double, nx double, ny double, nz double")
    hours = spark.createDataFrame([(0, 180.0, 89.0), (1, 180.0, 45.0), (2, 180.0, 3.0), (3, 180.0, -5.0)], "seq int, azimuth double, elevation double")
    found = {r["seq"]: r["frac"] for r in visibility.hourly_fractions(surface, hours, occluders, ("src",)).collect()}
    assert found == {0: 0.0, 1: 0.5, 2: 1.0}
    assert visibility.hourly_fractions(surface, hours, None, ("src",)).where("frac = 1").count() == 3


def test_hours_are_never_sorted_in_one_task(spark):
    for name in ("weather_assemble", "tmy_hour_index", "solar_position"):
        plan = weather_queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan
        windows = re.findall(r"Window \[(.*?)\], (\[.*?\])?", plan)
        assert not windows or name == "tmy_hour_index", plan  # that one numbers days
    raw = Warehouse(spark, SF).weather_raw()
    with pytest.raises(ValueError, match="usable hours"):
        weather.year(raw.where("false"))
