"""Binary STL files by ranges of records."""

import struct

import numpy as np

from calorix.sources import readers, stl


def put(path, n, said=None, extra=b""):
    values = np.arange(n * 9, dtype="<f4").reshape(n, 9) / 4
    body = b"".join(struct.pack("<3f", 0, 0, 1) + v.tobytes() + b"\0\0" for v in values)
    path.write_bytes(b"x" * 80 + struct.pack("<I", n if said is None else said) + body + extra)
    return values


def test_ranges_of_several_files(spark, tmp_path):
    values = {name: put(tmp_path / name, n, said, extra) for name, n, said, extra in (("a.stl", 1000, None, b""), ("b.stl", 7, 99, b"half a record"), ("c.stl", 5, 3, b""))}
    (tmp_path / "short.stl").write_bytes(b"x" * 20)
    (tmp_path / "other.txt").write_text("no mesh")
    found = stl.triangles(spark, f"{tmp_path}/*.stl", range_records=64)
    assert found.rdd.getNumPartitions() == 16 + 1 + 1
    rows = {(r["file"].rsplit("/", 1)[-1], r["tri_id"]): r for r in found.collect()}
    assert sorted(rows) == sorted([("a.stl", i) for i in range(1000)] + [("b.stl", i) for i in range(7)] + [("c.stl", i) for i in range(3)])
    for (name, i), r in rows.items():
        assert [r[c] for c in stl.CORNERS] == values[name][i].tolist()
    assert readers.mesh_file(spark, f"{tmp_path}/c.stl").count() == 3
