"""A refresh computes what changed, and nothing else."""

import glob
import os

from pyspark.sql import functions as F

from calorix.operators import refresh


def test_only_stale_groups_are_computed(spark, tmp_path):
    path, seen = f"file://{tmp_path}/store", []

    def compute(items):
        seen.append(sorted(r[0] for r in items.select("m").distinct().collect()))
        return items.groupBy("m").agg(F.sum("v").alias("total"))

    base = spark.range(200).selectExpr("id % 20 as m", "id as v")
    result, stale = refresh.refresh(base, "m", compute, path, 8)
    assert seen == [list(range(20))] and stale.count() == 20
    want = {r["m"]: r["total"] for r in base.groupBy("m").agg(F.sum("v").alias("total")).collect()}
    assert {r["m"]: r["total"] for r in result.collect()} == want
    files = {f: os.path.getmtime(f) for f in glob.glob(f"{tmp_path}/store/*/*.parquet")}
    refresh.refresh(base.repartition(7), "m", compute, path, 8)
    assert len(seen) == 1, "the same rows in another order are the same"
    changed = base.where("m <> 4 or v > 4").withColumn("v", F.when(F.col("m") == 3, F.col("v") + 1).otherwise(F.col("v"))).where("m <> 9").union(spark.createDataFrame([(99, 5)], "m long, v long"))
    result, stale = refresh.refresh(changed, "m", compute, path, 8)
    assert seen[1:] == [[3, 4, 99]] and sorted(r[0] for r in stale.collect()) == [3, 4, 99]
    want = {r["m"]: r["total"] for r in changed.groupBy("m").agg(F.sum("v").alias("total")).collect()}
    assert {r["m"]: r["total"] for r in result.collect()} == want
    now = set(glob.glob(f"{tmp_path}/store/*/*.parquet"))
    assert now & set(files), "buckets without a change are not written"
    result, _ = refresh.refresh(changed.where("m = 3"), "m", compute, path, 8)
    assert [r["m"] for r in result.collect()] == [3] and len(seen) == 2 or seen[2:] == [[]]


def test_a_first_run_looks_no_keys_up_and_keys_may_be_null(spark, tmp_path, monkeypatch):
    names, written = [], refresh.written
    monkeypatch.setattr(refresh, "written", lambda df, name="step": names.append(name) or written(df, name))
    base = spark.range(30).selectExpr("if(id % 5 = 4, null, id % 5) as m", "id as v")
    compute = lambda items: items.groupBy("m").agg(F.sum("v").alias("total"))
    result, _ = refresh.refresh(base, "m", compute, f"file://{tmp_path}/store", 4)
    assert names == ["versions"] and {r["m"] for r in result.collect()} == {0, 1, 2, 3}
    result, stale = refresh.refresh(base.withColumn("v", F.when(F.col("m") == 2, F.col("v") * 2).otherwise(F.col("v"))), "m", compute, f"file://{tmp_path}/store", 4)
    assert {r["m"]: r["total"] for r in result.collect()} == {0: 75, 1: 81, 2: 174, 3: 93}
    assert 2 in {r["m"] for r in stale.collect()}
