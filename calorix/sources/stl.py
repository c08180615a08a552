"""Binary STL files as a Python data source: ranges of records are tasks, so that a file of any size spreads out.

A record has 50 bytes after a head of 84, so a range knows its first triangle's number
without reading what is before it.  Rows carry their file; tri_id counts within it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from calorix.sources import boxed

# Workers that plan and read get these modules by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HEAD, RECORD = 84, np.dtype([("normal", "<f4", 3), ("corners", "<f4", 9), ("attribute", "<u2")])
RANGE_RECORDS, ROWS = 1_000_000, 50_000
CORNERS = [f"{c}{i}" for i in range(3) for c in "xyz"]
SCHEMA = "file string, tri_id long, " + ", ".join(f"{c} double" for c in CORNERS)


class StlReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.records = options["path"], int(options.get("rangerecords", RANGE_RECORDS))

    def partitions(self) -> list[boxed.Range]:
        """Ranges of records: as many as the head says, and no more than the file has whole."""
        out = []
        for path, size in boxed.files_of(self.path):
            system, name = boxed.opened(path)
            if size < HEAD:
                continue
            with system.open_input_file(name) as file:
                said = int.from_bytes(file.read_at(4, HEAD - 4), "little")
            n = min(said, (size - HEAD) // RECORD.itemsize)
            out += [boxed.Range(path, a, min(a + self.records, n), n) for a in range(0, n, self.records)]
        return out

    def read(self, part: boxed.Range) -> Iterator[pa.RecordBatch]:
        system, name = boxed.opened(part.path)
        with system.open_input_file(name) as file:
            for a in range(part.start, part.stop, ROWS):
                n = min(ROWS, part.stop - a)
                records = np.frombuffer(file.read_at(n * RECORD.itemsize, HEAD + a * RECORD.itemsize), RECORD)
                corners = records["corners"].astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * n), pa.array(np.arange(a, a + n)), *(pa.array(corners[:, i]) for i in range(9))], ["file", "tri_id", *CORNERS])


class StlSource(ds.DataSource):
    """Format ``binary_stl``: options path, rangeRecords."""

    @classmethod
    def name(cls) -> str:
        return "binary_stl"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> StlReader:
        return StlReader(dict(self.options))


def triangles(spark: SparkSession, path: str, range_records: int = RANGE_RECORDS) -> DataFrame:
    """Triangles of an STL file or of all files of a folder or pattern; a file without whole records gives none."""
    spark.dataSource.register(StlSource)
    return spark.read.format("binary_stl").options(path=path, rangeRecords=str(range_records)).load()
