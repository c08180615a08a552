"""Scans with a pushed box: splits, files, stops and odd collections."""

import json

import pytest

from calorix.sources import boxed, readers


def feature(i, lat, lon, **more):
    ring = [[lon, lat], [lon + 0.01, lat], [lon + 0.01, lat + 0.01], [lon, lat]]
    return {"type": "Feature", "id": i, "properties": {"n": i, "note": 'a "type": {"type":"Feature"} in text, é', "hauteur": "7.5", **more}, "geometry": {"type": "Polygon", "coordinates": [ring]}}


@pytest.fixture(scope="module")
def collections(tmp_path_factory):
    """Two files whose features follow each other in two styles, and one without features."""
    top = tmp_path_factory.mktemp("boxes")
    for k, style in enumerate(({}, {"indent": 1})):
        doc = {"type": "FeatureCollection", "features": [feature(1000 * k + i, i % 50, k * 100 + i // 50) for i in range(500)], "after": [1, 2]}
        (top / f"f{k}.json").write_text(json.dumps(doc, **style))
    (top / "none.json").write_text('{"type": "FeatureCollection", "features": []}')
    return str(top)


@pytest.mark.parametrize("split", [257, 5000, 1 << 26])
@pytest.mark.parametrize("block", [300, 1 << 22])
def test_splits_lose_and_double_nothing(collections, monkeypatch, split, block):
    monkeypatch.setattr(boxed, "BLOCK_BYTES", block)
    reader = boxed.BoxedReader({"path": collections, "splitbytes": str(split)})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(r["id"] for r in rows) == [1000 * k + i for k in range(2) for i in range(500)]
    assert len({(r["file"], r["at"]) for r in rows}) == 1000
    assert dict(rows[0]["tags"])["note"].endswith("é") and dict(rows[0]["tags"])["n"] == "0"


def test_box_reaches_the_scan(spark, collections):
    found = boxed.scan(spark, collections, (9.5, 0.0, 12.5, 3.5), split_bytes=5000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan boxed_json" in plan and "Filter (" not in plan, plan
    assert sorted(r["id"] for r in found.collect()) == sorted(i for i in range(500) if 9.49 <= i % 50 <= 12.5 and i // 50 <= 3.5)
    both = boxed.scan(spark, collections, (0.0, 0.0, 50.0, 200.0)).where("id % 100 = 0")
    assert both.count() == 10


def test_a_request_stops(spark, collections):
    reader = boxed.BoxedReader({"path": collections, "most": "10"})
    assert [sum(b.num_rows for b in reader.read(p)) for p in reader.partitions()] == [10, 10, 0]
    kept = boxed.scan(spark, collections, (20.0, 0.0, 90.0, 200.0), most=70, split_bytes=5000).collect()
    assert [r["id"] for r in kept] == [i for i in range(500) if 19.99 <= i % 50][:70]


def test_elements_and_odd_collections(spark, tmp_path):
    elements = [{"type": "node", "id": 5, "lat": 1.0, "lon": 2.0}, {"type": "way", "id": 6, "tags": {"height": "3 m"}, "geometry": [{"lat": 1.0, "lon": 2.0}] * 3}, {"type": "relation", "id": 7}]
    (tmp_path / "e.json").write_text(json.dumps({"version": 0.6, "elements": elements}))
    rows = {r["id"]: r for r in boxed.scan(spark, str(tmp_path / "e.json")).collect()}
    assert rows[5]["south"] == 1.0 and rows[6]["tags"] == {"height": "3 m"} and rows[7]["north"] is None
    assert {r["id"] for r in boxed.scan(spark, str(tmp_path / "e.json"), (0, 0, 5, 5)).collect()} == {5, 6}
    (tmp_path / "odd.json").write_text(json.dumps({"features": [{"properties": None, "geometry": None}, {"id": "x", "properties": {"a": {"b": 1}}, "geometry": {"type": "Point", "coordinates": [2, 1]}}]}))
    odd = boxed.scan(spark, [str(tmp_path / "odd.json"), str(tmp_path / "e.json")], split_bytes=40).collect()
    assert len(odd) == 5 and {r["file"].rsplit("/", 1)[-1] for r in odd} == {"odd.json", "e.json"}
    assert [r["tags"] for r in odd if r["kind"] == "Point"] == [{"a": '{"b": "1"}'}]


def test_written_features_come_back(spark, tmp_path):
    rows = spark.range(0, 40, 1, 3).selectExpr("map('hauteur', cast(id as string)) AS properties", "array(named_struct('lat', id * 1.0D, 'lon', 2D), named_struct('lat', id + 0.5D, 'lon', 2D), named_struct('lat', id * 1.0D, 'lon', 3D)) AS ring")
    boxed.write_features(rows, f"file://{tmp_path}/out")
    found = readers.feature_buildings(spark, f"file://{tmp_path}/out", bbox=(10.2, 0.0, 12.0, 9.0)).collect()
    assert sorted(r["height"] for r in found) == [10.0, 11.0, 12.0] and not any(r["approx"] for r in found)
    with pytest.raises(ValueError):
        readers.mesh_file(spark, "x.abc")
