"""Batches of calls: sizes, short answers, failures, fallbacks by request."""

from pyspark.sql import functions as F

from calorix.operators import lookups


def points(spark, n_by_request):
    rows = [(r, i, float(i), float(r), True) for r, n in n_by_request.items() for i in range(n)]
    return spark.createDataFrame(rows, "r long, i long, lat double, lon double, ok boolean").repartition(5)


def test_batches_and_fallbacks(spark):
    def first(lats, lons):
        if len(lats) > 60 or lats != sorted(lats):
            raise AssertionError("a call is of 60 points in order")
        if lons[0] == 3.0:
            raise OSError("down")
        return lats[:-1] if lons[0] == 2.0 and lats[0] == 60.0 else lats

    def second(lats, lons):
        if lons[0] == 3.0 and len(lats) == 100:
            return [0.0]
        return [-x for x in lats]

    asked = points(spark, {1: 130, 2: 70, 3: 101, 4: 1, 5: 3}).withColumn("ok", F.col("r") != 5)
    found = lookups.looked_up(asked, first, second, ("r",), ("i",), "ok").collect()
    assert len(found) == 305
    by = {(r["r"], r["i"]): (r["value"], r["service"], r["failed"]) for r in found}
    assert by[1, 129] == (129.0, "first", None) and by[4, 0] == (0.0, "first", None)
    assert {by[2, i] for i in range(70)} == {(-float(i), "second", None) for i in range(70)}, "one short answer sends the whole request on"
    assert {by[3, i] for i in range(101)} == {(None, None, "OSError: down; 1 values for 100 points")}
    assert by[5, 2] == (-2.0, "second", None), "not suited to the first"
    assert lookups.looked_up(asked.where("r > 9"), first, second, ("r",), ("i",)).count() == 0


def test_calls_take_no_group_map(spark):
    """Calls run over rows of one call each; a null place reaches the service as no number, and no number comes back as none."""
    asked = points(spark, {1: 61, 2: 3}).withColumns({"place": F.col("i"), "lat": F.when(F.col("i") != 60, F.col("lat"))})
    made = lookups.called(asked, lambda lats, lons: lats, ("r",), 60)
    assert "InPandas" not in made._jdf.queryExecution().executedPlan().toString()
    rows = made.collect()
    assert len(rows) == 64 and all(r["failed"] is None and r["value"] == (None if r["place"] == 60 else float(r["place"])) for r in rows)
