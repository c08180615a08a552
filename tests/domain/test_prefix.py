"""Places and running totals against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from calorix.operators.prefix import running


def plain(rows):
    """(id, group, at, size) to (id, place, size_before) by group."""
    out, ahead = {}, {}
    for i, g, at, n in sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[2] is None, -(r[2] or 0), r[0])):
        place, total = ahead.get(g, (0, 0))
        out[i] = place, total
        ahead[g] = place + 1, total + (n or 0)
    return out


@pytest.mark.parametrize("groups", [["a"], ["a", "b", None], list(map(str, range(300)))])
def test_running(spark, groups):
    rng = random.Random(len(groups))
    rows = [(i, groups[0] if rng.random() < 0.4 else rng.choice(groups), rng.choice([None, *range(50)]), rng.choice([None, 0, 1, 7])) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, g string, at long, size int")
    found = running(df.repartition(7), (("at", False), "id"), ("size",), ("g",))
    assert found.columns == ["id", "g", "at", "size", "place", "size_before"]
    assert {r["id"]: (r["place"], r["size_before"]) for r in found.collect()} == plain(rows)


def test_equal_rows_and_none(spark):
    same = spark.range(0, 3000, 1, 5).select(F.lit(1).alias("k"))
    found = running(same, ("k",))
    assert sorted(r["place"] for r in found.collect()) == list(range(3000))
    assert running(same.where("k > 1"), ("k",), ("k",)).collect() == []
    assert "Window" not in found._jdf.queryExecution().toString()
