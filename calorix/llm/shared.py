"""Helpers that the training-data operators share: materialised steps, columns, words."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, as in ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A list of row keys of at most this many rows may be broadcast (8 bytes each); longer ones are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Rows of an Arrow batch in steps that are written.
TEXTS_AT_ONCE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a temporary one only where all run on this machine."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = f"file://{tempfile.mkdtemp(prefix='spark-shared-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", there)
    return there


def materialise(df: DataFrame, name: str, rows: int = TEXTS_AT_ONCE, row_group: int | None = None) -> DataFrame:
    """Write a step to the shared folder and read it back: cuts lineage and survives lost executors; rows: of an Arrow batch; row_group: rows that are written, and later read, at once."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with few_rows_a_batch(df.sparkSession, rows), shuffles_dropped(df.sparkSession):
        df.write.options(**({"parquet.block.row.count.limit": row_group} if row_group else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def few_rows_a_batch(spark: SparkSession, rows: int = TEXTS_AT_ONCE) -> Iterator[None]:
    """Rows go to Python so many at a time, so that a task holds few whole texts; the session's setting comes back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drop_step(step: DataFrame) -> None:
    """Take a written step off the shared folder; nothing that is still read may come from it."""
    jvm, there = step.sparkSession.sparkContext._jvm, shared_dir(step.sparkSession).rstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in step.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.getParent().toUri().getPath() == jvm.org.apache.hadoop.fs.Path(there).toUri().getPath():
            path.getFileSystem(step.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a written step leaves the disks when the step is there, not when the driver next collects garbage; the session's setting comes back after."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fold(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def semi_or_anti(docs: DataFrame, keys: DataFrame, key: str, how: str, n_keys: int) -> DataFrame:
    """Null-safe semi or anti join on ``key``; the keys are broadcast only up to BROADCAST_ROWS rows."""
    keys = keys.select(F.col(key).alias("__key"))
    keys = F.broadcast(keys) if n_keys <= BROADCAST_ROWS else keys
    return docs.join(keys, docs[key].eqNullSafe(keys["__key"]), how)


def text_digest() -> Column:
    """XXH64 of the folded text: with doc_id it names a row's text where ids are null or repeated."""
    return F.xxhash64(fold(F.col("text").cast("string"))).alias("digest")


def one_of_each(docs: DataFrame, rows: DataFrame, group: str, best) -> DataFrame:
    """The documents with one row of each group; ``rows`` has doc_id, digest and group of every one.

    The row with the best (``F.min`` or ``F.max``) doc_id stays; a null id only
    if all are null.  Of several with that id the one with the least digest stays,
    of rows that repeat both the least one by its other columns.
    """
    # Ids of the wanted end sort first; a null id sorts after all others.
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), (F.col("doc_id") if best is F.min else F.bitwise_not("doc_id")).alias("at"), "digest", "doc_id")
    keys = materialise(rows.groupBy(group, "doc_id", "digest").agg(F.count(F.lit(1)).alias("n")), "row-keys")
    kept = keys.groupBy(group).agg(F.min(rank).alias("kept"), F.sum("n").alias("all")).where("all > 1")
    shared = materialise(
        keys.join(kept, group).select("doc_id", "digest", "n", (F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("digest") == F.col("kept.digest"))).alias("stays")),
        "grouped-rows",
    )
    dropped, repeats = shared.where("not stays"), shared.where("stays and n > 1")

    def met(part: DataFrame, keys: DataFrame, how: str, n: int) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__key"))
        keys = F.broadcast(keys) if n <= BROADCAST_ROWS else keys
        return part.join(keys, (part["__digest"] == keys["__key"]) & part["doc_id"].eqNullSafe(keys["__id"]), how)

    marked = met(docs.withColumn("__digest", text_digest()), dropped, "left_anti", dropped.count())
    if n := repeats.count():
        once = met(marked, repeats, "left_semi", n).groupBy("doc_id", "__digest").agg(F.min(F.struct(*docs.columns)).alias("__row")).select("__row.*")
        return met(marked, repeats, "left_anti", n).select(*docs.columns).unionByName(once)
    return marked.select(*docs.columns)


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings of a text column, null as empty."""
    return pc.fill_null(column, "").to_pylist()


def cut(batch: pa.RecordBatch, text: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text, one row at least."""
    if batch.num_rows:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // most
        starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            yield batch.slice(a, b - a)


def folded(column: pa.Array) -> pa.Array:
    """Text column with A-Z lower-cased and null as empty."""
    return pc.ascii_lower(pc.fill_null(column, ""))


def trimmed(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function for mapInArrow that gives freed memory back when its task ends: workers live on for other stages."""

    @functools.wraps(function)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run
