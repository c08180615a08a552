"""Values of points from services that answer some points a call, with a fallback per request.

A request's points are called in batches by their place in it, however rows are
dealt out.  A call that fails or answers with another length makes the whole
request go to the second service, as an answer that can't be matched to its points is
worth nothing; where both fail there are no values, and why.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calorix.operators.prefix import running
from calorix.sources.stage import written

#: A service: latitudes and longitudes of one call to as many values.
Service = Callable[[Sequence[float], Sequence[float]], Sequence[float]]
#: Points of a call to the first and the second service.
BATCHES = (60, 100)


def called(points: DataFrame, service: Service, by: tuple[str, ...], most: int) -> DataFrame:
    """(by, place, value, failed): one call a batch of ``most`` points; ``failed`` says why a batch has no values."""

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given, kept, values, failed = batch.column("points"), [], [], []
            for i in range(batch.num_rows):
                place, lat, lon = (c.to_numpy(zero_copy_only=False).tolist() for c in given[i].values.flatten())
                try:
                    got, why = [float(v) for v in service(lat, lon)], None
                    if len(got) != len(place):
                        got, why = None, f"{len(got)} values for {len(place)} points"
                except Exception as wrong:  # whatever a service raises is an answer that can't be used
                    got, why = None, f"{type(wrong).__name__}: {wrong}"
                kept += place
                values += got if got is not None else [None] * len(place)
                failed += [why] * len(place)
            sizes = pc.list_value_length(given).to_numpy(zero_copy_only=False)
            own = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            found = [pa.array(kept, pa.int64()), pa.array(values, pa.float64(), from_pandas=True), pa.array(failed, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(own) for c in by), *found], [*by, "place", "value", "failed"])

    keys = points.select(*by).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keys), "place long", "value double", "failed string"])
    calls = points.groupBy(*by, F.floor(F.col("place") / most).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("place", "lat", "lon"))).alias("points"))  # the points of one call
    return calls.select(*by, "points").mapInArrow(call, schema)


def looked_up(points: DataFrame, first: Service, second: Service, by: tuple[str, ...], order: tuple[str, ...], suited: str | None = None, batches: tuple[int, int] = BATCHES) -> DataFrame:
    """Points with value, service (first or second, null where both failed) and failed.

    ``suited`` names a boolean column: a request whose first point isn't suited to the
    first service goes to the second at once.  An empty table gives no rows.
    """
    placed = written(running(points, order, by=by), "asked")
    wanted = F.coalesce(F.min_by(F.col(suited), "place"), F.lit(False)) if suited else F.lit(True)
    requests = placed.groupBy(*by).agg(wanted.alias("__suited"))
    one = written(called(placed.join(requests.where("__suited"), list(by), "left_semi"), first, by, batches[0]), "first-calls")
    ended = one.groupBy(*by).agg(F.max("failed").alias("__why")).withColumn("__done", F.lit(True))
    state = written(requests.join(ended, list(by), "left").select(*by, "__why", (F.coalesce("__done", F.lit(False)) & F.col("__why").isNull()).alias("__good")), "requests")
    rest = placed.join(state.where("not __good"), list(by), "left_semi")
    two = written(called(rest, second, by, batches[1]), "second-calls")
    wrong = two.groupBy(*by).agg(F.max("failed").alias("__wrong"))
    told = state.where("not __good").join(wrong, list(by)).select(*by, "__wrong", F.concat_ws("; ", "__why", "__wrong").alias("__all"))
    by_first = one.join(state.where("__good"), list(by), "left_semi").select(*by, "place", "value", F.lit("first").alias("service"), F.lit(None).cast("string").alias("failed"))
    ok = F.col("__wrong").isNull()
    by_second = two.join(told, list(by)).select(*by, "place", F.when(ok, F.col("value")).alias("value"), F.when(ok, "second").alias("service"), F.when(~ok, F.col("__all")).alias("failed"))
    return placed.join(by_first.unionByName(by_second), [*by, "place"]).drop("place")
