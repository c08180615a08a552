"""Readers on inline documents, entity changes, and stream against batch."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from calorix.operators import entities, places, weather
from calorix.sources import readers
from calorix.streaming import hourly


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(text) if isinstance(text, bytes) else path.write_text(text)
    return str(path)


def test_archive_clamps_and_skips(spark, tmp_path):
    doc = {"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00", "2024-01-01T02:00"], "temperature_2m": [500.0, None, -500.0], "direct_normal_irradiance": [5000.0, 1.0, -10.0], "diffuse_radiation": [5000.0, 1.0], "wind_speed_10m": [3.0]}}
    raw = readers.archive_hours(spark, put(tmp_path, "a.json", json.dumps(doc)))
    assert raw.count() == 3
    kept = weather.clamped(weather.kept_hours(raw)).collect()
    assert [(r["t_ext"], r["e_dir"], r["e_dif"], r["wind_m_s"]) for r in kept] == [(60.0, 1400.0, 600.0, 3.0)]
    with pytest.raises(Exception):
        weather.checked(raw.where("t_ext_raw > 1e9")).count()


def test_day_gap_counts_in_archives_but_not_in_typical_years(spark):
    rows = [(f"2024-01-{d:02d} {h:02d}:00:00", 1.0 if d != 2 else None, 1.0, 1.0, None) for d in (1, 2, 3) for h in range(24)]
    raw = spark.createDataFrame(rows, "t string, t_ext_raw double, e_dir_raw double, e_dif_raw double, wind_raw double").withColumn("hour_ts", F.col("t").cast("timestamp_ntz"))
    kept = weather.kept_hours(raw)
    assert [r["hour_index"] for r in weather.local_hour_index(kept, 0).orderBy("hour_ts").collect()][24] == 48
    assert [r["hour_index"] for r in weather.change_hour_index(kept, "hour_ts").orderBy("hour_ts").collect()] == list(range(48))
    late = [r["hour_index"] for r in weather.local_hour_index(kept, -8 * 3600).orderBy("hour_ts").collect()]
    assert late[0] == 16 and min(late) == 16


def test_typical_year_times(spark, tmp_path):
    doc = {"outputs": {"tmy_hourly": [{"time(UTC)": "20081215:1430", "T2m": 1.0, "Gb(n)": 2.0, "Gd(h)": 3.0, "WS10m": 4.0}, {"time(UTC)": "junk", "T2m": 1.0}]}}
    rows = readers.typical_hours(spark, put(tmp_path, "t.json", json.dumps(doc))).collect()
    assert str(rows[0]["hour_ts"]) == "2008-12-15 14:30:00" and rows[1]["hour_ts"] is None


def test_buildings_and_vegetation(spark, tmp_path):
    ring = [[2.0, 48.0, 5], [2.1, 48.0, 5], [2.1, 48.1, 5]]
    doc = {"features": [
        {"properties": {"hauteur": "0", "nombre_d_etages": "2", "nature": "Haie"}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
        {"properties": {"nature": "?"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}},
        {"properties": {}, "geometry": {"type": "Polygon", "coordinates": [ring[:2]]}},
    ]}
    path = put(tmp_path, "f.json", json.dumps(doc))
    rows = readers.feature_buildings(spark, path).orderBy("at").collect()
    assert [(r["height"], r["approx"]) for r in rows] == [(6.0, True), (6.0, True)] and rows[0]["lat"] == pytest.approx(48.0333333)
    assert [r["height"] for r in readers.feature_vegetation(spark, path).orderBy("at").collect()] == [3.0, 10.0]
    doc = {"elements": [
        {"type": "way", "id": 1, "tags": {"height": "12,5 m", "building:levels": "3"}, "geometry": [{"lat": 1.0, "lon": 2.0}] * 3},
        {"type": "node", "id": 2, "lat": 1.0, "lon": 2.0, "tags": {"leaf_type": "needleleaved", "circumference": "0.2"}},
    ]}
    path = put(tmp_path, "e.json", json.dumps(doc))
    assert readers.element_buildings(spark, path).first()["height"] == 12.0
    trees, zones = readers.element_vegetation(spark, path)
    assert (trees.first()["height"], trees.first()["radius"]) == (14.0, 1.5) and zones.count() == 1


def test_text_readers(spark, tmp_path):
    path = put(tmp_path, "w.txt", "t;az;el;d;f\n1,5;180;30;500;80;3\n2.5,190,31,510,81\nbad;1\n")
    rows = readers.weather_text(spark, path).orderBy("seq").collect()
    assert [(r["t_ext"], r["e_dif"], r["wind_m_s"]) for r in rows] == [(1.5, 80.0, 3.0), (2.5, 81.0, None)]
    good = put(tmp_path, "s.txt", "\n".join(f"{i};0,5;10;{i % 2}" for i in range(24)))
    assert readers.schedule_text(spark, good).where("shut").count() == 12
    with pytest.raises(Exception):
        readers.schedule_text(spark, put(tmp_path, "s2.txt", "1;2;3\n" * 23)).count()


def test_mesh_readers(spark, tmp_path):
    obj = "o first\nv 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1 2/2 3/3 4/4\ng second\nf 1 2 3\n"
    rows = readers.mesh_file(spark, put(tmp_path, "m.obj", obj)).orderBy("tri_id").collect()
    assert [(r["grp"], r["x2"], r["y2"]) for r in rows] == [("first", 1.0, 1.0), ("first", 0.0, 1.0), ("second", 1.0, 1.0)]
    stl = b"\0" * 80 + struct.pack("<I", 1) + struct.pack("<12fH", *[0] * 3, *range(9), 0)
    assert readers.mesh_file(spark, put(tmp_path, "m.stl", stl)).first()["z2"] == 8.0
    with pytest.raises(ValueError):
        readers.mesh_file(spark, "x.ply")


def test_entity_changes(spark):
    b = spark.createDataFrame([(1, 10, "a", False), (2, 20, "b", False)], "id long, environment_id long, name string, sun_visibility_stale boolean")
    part = entities.partly_updated(b, spark.createDataFrame([(1, None, "z")], "id long, environment_id long, name string"), "id").orderBy("id").collect()
    assert (part[0]["environment_id"], part[0]["name"]) == (10, "z")
    assert [r["sun_visibility_stale"] for r in entities.stale_after(b, spark.createDataFrame([(10,)], "environment_id long")).orderBy("id").collect()] == [True, False]
    env = spark.createDataFrame([(10,), (20,)], "environment_id long")
    left, freed = entities.deleted_with_null(env, b, env.where("environment_id = 10"), "environment_id")
    assert left.count() == 1 and [r["environment_id"] for r in freed.orderBy("id").collect()] == [None, 20]
    users = spark.createDataFrame([("x@y.z", "X")], "email string, display_name string")
    once = entities.inserted_if_absent(users, spark.createDataFrame([("x@y.z", "other"), ("n@y.z", "N")], users.schema), "email")
    assert once.count() == 2 and once.where("display_name = 'other'").count() == 0
    assert entities.taken_names(spark.createDataFrame([(3, "a")], "id long, name string"), b).count() == 1
    assert entities.unknown_references(b, env.where("environment_id = 20"), "environment_id").first()["unknown"] == [10]
    ok, bad = entities.split_by(b, F.col("id") == 1)
    assert ok.count() == bad.count() == 1


def test_admission_stops_at_the_first_item_over_the_cap(spark):
    items = spark.createDataFrame([(1, 5), (2, 6), (3, 1)], "d int, n int")
    assert [(r["d"], r["n_offset"]) for r in places.admitted(items, ("n",), (10,), ("d",)).collect()] == [(1, 0)]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(1).write.parquet(f"{tmp_path}/events")
    stream = hourly.hourly_channels(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events"))
    q = stream.writeStream.outputMode("append").format("memory").queryName("hourly").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    batch = hourly.hourly_channels(events)
    last = batch.agg(F.max("hour_ts")).first()[0]
    assert spark.table("hourly").exceptAll(batch).count() == 0
    assert spark.table("hourly").count() >= batch.where(F.col("hour_ts") < F.lit(last) - F.expr("interval 3 hours")).count()
