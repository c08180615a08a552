"""Places and running totals in an order over any number of rows.

Rows are dealt by ranges of (group, order) and sorted there; every task sums its
own rows, one row per range goes to the driver, and what the ranges before it hold
of a range's first group is added back.  No window spans all rows or a whole
group, so a group may be of any size; equal rows are spread over ranges too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calorix.sources.stage import written

PART_BITS = 33  # monotonically_increasing_id keeps the row's place in its task in as many low bits


def _starts(keys: list[pa.Array], before: list | None) -> np.ndarray:
    """Whether each row's group differs from the one of the row ahead; nulls are equal.  before: the keys of the row ahead of the first."""
    n = len(keys[0]) if keys else 0
    new = np.zeros(n, bool)
    for i, k in enumerate(keys):
        a, b = k.slice(0, n - 1), k.slice(1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        new[1:] |= ~same.to_numpy(zero_copy_only=False)
        new[0] |= before is not None and before[i] != k[0].as_py()
    return new


def running(rows: DataFrame, order: tuple[str | tuple[str, bool], ...], sizes: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """Rows with ``place`` (from 0) in the order and, for every size column, ``<size>_before``: the total of the rows ahead (within each group ``by``).

    An end of the order is a column's name or (name, ascending); nulls come last.
    Sizes are whole numbers, null counts as 0; ties in the order fall in any one
    order that the written step fixes; an empty table gives none.
    """
    columns, spark = rows.columns, rows.sparkSession
    keyed = written(rows.withColumn("__tie", F.monotonically_increasing_id()), "order")
    ends = [*by, *map(_directed, order), "__tie"]
    dealt = keyed.repartitionByRange(*ends).sortWithinPartitions(*ends).select(*columns, F.monotonically_increasing_id().alias("__at"))
    sums = ["place", *[f"{c}_before" for c in sizes]]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead, total, groups = None, np.zeros(len(sums), np.int64), 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = [batch.column(c) for c in by]
            new = _starts(keys, ahead) if by else np.zeros(n, bool)
            ahead = [k[n - 1].as_py() for k in keys]
            steps = [np.ones(n, np.int64), *(pc.fill_null(batch.column(c).cast(pa.int64()), 0).to_numpy(zero_copy_only=False) for c in sizes)]
            group = groups + np.cumsum(new)
            first = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # row at which the group of this batch starts, -1 if ahead of it
            out = []
            for i, step in enumerate(steps):
                summed = np.concatenate([[0], np.cumsum(step)])
                out.append(summed[:-1] - summed[np.maximum(first, 0)] + np.where(first < 0, total[i], 0))
                total[i] = out[-1][-1] + step[-1]
            groups = int(group[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group == 0), *map(pa.array, out)], [*batch.schema.names, "__head", *sums])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema), "__head boolean", *(f"`{s}` long" for s in sums)])
    placed = written(dealt.mapInArrow(add, schema), "placed").withColumn("__part", F.shiftright("__at", PART_BITS))
    key = F.struct(F.lit(0), *by)
    after = F.struct(*[F.col(s) + F.coalesce(F.col(c).cast("long"), F.lit(0)) if c else F.col(s) + 1 for s, c in zip(sums, [None, *sizes])])
    ranges = placed.groupBy("__part").agg(F.min_by(key, "__at").alias("head"), F.max_by(key, "__at").alias("tail"), F.max_by(after, "__at").alias("after"), F.bool_and("__head").alias("single")).orderBy("__part").collect()  # one row per range
    carried, tail, total = [], None, [0] * len(sums)
    for r in ranges:
        carry = total if tail == r["head"] else [0] * len(sums)
        carried.append((r["__part"], *carry))
        total = [a + c for a, c in zip(r["after"], carry)] if r["single"] else list(r["after"])
        tail = r["tail"]
    offsets = spark.createDataFrame(carried, "__part long, " + ", ".join(f"__c{i} long" for i in range(len(sums))))
    joined = placed.join(F.broadcast(offsets), "__part")  # as many rows as ranges
    return joined.select(*columns, *[F.when(F.col("__head"), F.col(s) + F.col(f"__c{i}")).otherwise(F.col(s)).alias(s) for i, s in enumerate(sums)])


def _directed(end: str | tuple[str, bool]) -> Column:
    name, ascending = (end, True) if isinstance(end, str) else end
    return F.col(name).asc_nulls_last() if ascending else F.col(name).desc_nulls_last()
