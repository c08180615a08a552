"""Steps that are read again: written to the session's shared folder and read back."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str = "step") -> str:
    """A new path where driver and executors share a folder; a temporary one only where all run on this machine."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = f"file://{tempfile.mkdtemp(prefix='spark-shared-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", there)
    return f"{there}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def short_methods(spark: SparkSession) -> Iterator[None]:
    """Plans run meanwhile leave generated methods that the JVM would not compile (of over 8000 bytes): long formulas then run in several short ones."""
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "8000")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """The rows, written to the shared folder and read back."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
