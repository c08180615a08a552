"""Scans of map collections (features or tagged elements in JSON) that take the box as a pushed filter.

A Python data source splits every file by byte ranges: a range yields the objects
that start in it, found by the bytes they start with, so that a collection of any
size is read in parts and never held whole.  Comparisons on an object's box are
evaluated while parsing, and a range stops after as many rows as a request may have.
Rows carry their file and byte offset, which is their order.  Files whose objects
start with another key than ``type`` are read as one range.
"""

from __future__ import annotations

import fnmatch
import json
import operator
import re
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as ds

# Workers that plan and read get this module by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BOX = ("south", "west", "north", "east")
SCHEMA = "file string, at long, kind string, id long, tags map<string,string>, lat double, lon double, ring array<struct<lat double, lon double>>, " + ", ".join(f"{c} double" for c in BOX)
SPLIT_BYTES, BLOCK_BYTES, HEAD_BYTES, ROWS = 64 << 20, 4 << 20, 1 << 16, 1000
LIST = re.compile(rb'"(features|elements)"\s*:\s*\[\s*')
START = re.compile(rb'\{\s*"type"\s*:\s*"(?:Feature|node|way|relation)"')
POINT = pa.struct([("lat", pa.float64()), ("lon", pa.float64())])
ARROW = pa.schema([("file", pa.string()), ("at", pa.int64()), ("kind", pa.string()), ("id", pa.int64()), ("tags", pa.map_(pa.string(), pa.string())), ("lat", pa.float64()), ("lon", pa.float64()), ("ring", pa.list_(POINT)), *((c, pa.float64()) for c in BOX)])
COMPARE = {ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.EqualTo: operator.eq}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it; a path without a scheme is a local one."""
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+.-]+:/", path) else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files of a folder or of a pattern in a folder's names, in order."""
    folder, _, last = path.rpartition("/")
    pattern = last if re.search(r"[*?\[]", last) else None
    system, name = opened(folder if pattern else path)
    info = system.get_file_info(name)
    files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(name, recursive=pattern is None))
    scheme = path[: path.index(":") + 3] if system.type_name != "local" else ""
    taken = [f for f in files if f.type == fs.FileType.File and (pattern is None and not f.base_name.startswith(("_", ".")) or pattern is not None and fnmatch.fnmatch(f.base_name, pattern))]
    return [(scheme + f.path, f.size) for f in sorted(taken, key=lambda f: f.path)]


class Range(ds.InputPartition):
    """Bytes of one file; objects that start in them."""

    def __init__(self, path: str, start: int, stop: int, size: int):
        super().__init__((path, start))
        self.path, self.start, self.stop, self.size = path, start, stop, size


def objects(path: str, start: int, stop: int, size: int) -> Iterator[tuple[int, dict]]:
    """Offset and content of the list's objects that start in a byte range."""
    system, name = opened(path)
    decoder = json.JSONDecoder(parse_float=str, parse_int=str)
    with system.open_input_file(name) as file:
        head = file.read_at(min(HEAD_BYTES, size), 0)
        found = LIST.search(head)
        if found is None or not START.match(head, found.end()):
            if start == 0:  # one range has it all
                text = file.read_at(size, 0).decode()
                begin = re.search(r'"(?:features|elements)"\s*:\s*\[', text)
                at = begin.end() if begin else len(text)
                while at < len(text) and (m := re.compile(r"[\s,]*(?=\{)").match(text, at)):
                    content, after = decoder.raw_decode(text, m.end())
                    yield m.end(), content
                    at = after
            return
        at = max(start, found.end())
        held, base, first = b"", at, None  # bytes from `base` on; where the object that is being read starts
        while True:
            block = file.read_at(min(BLOCK_BYTES, size - base - len(held)), base + len(held))
            held += block
            ended = base + len(held) >= size
            for m in START.finditer(held):
                if first is not None and m.start() > first:
                    yield base + first, decoder.raw_decode(held[first : m.start()].decode())[0]
                first = m.start()
                if base + first >= stop:
                    return
            if ended:
                if first is not None:
                    yield base + first, decoder.raw_decode(held[first:].decode())[0]
                return
            # Keep the object that isn't whole yet, or what may be the beginning of a start.
            keep = first if first is not None else max(0, len(held) - 256)
            if first is None and base + keep >= stop:
                return
            held, base, first = held[keep:], base + keep, 0 if first is not None else None


def text_of(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


def row_of(path: str, at: int, thing: dict) -> dict:
    """The row of a feature (type, properties, geometry) or of an element (type, id, lat, lon, tags, geometry)."""
    geometry, lat, lon = thing.get("geometry"), None, None
    if isinstance(geometry, dict) or "properties" in thing:
        geometry = geometry or {}
        kind, ring = geometry.get("type"), geometry.get("coordinates") or []
        depth = {"Polygon": 1, "MultiPolygon": 2}.get(kind)
        for _ in range(depth or 0):
            ring = ring[0] if ring else []
        if kind == "Point" and len(ring) > 1:
            lat, lon = float(ring[1]), float(ring[0])
        ring = [{"lat": float(p[1]), "lon": float(p[0])} for p in ring] if depth else None
        tags = thing.get("properties")
    else:
        kind, tags = thing.get("type"), thing.get("tags")
        ring = [{"lat": float(p["lat"]), "lon": float(p["lon"])} for p in geometry] if geometry else None
        lat, lon = (float(thing[c]) if thing.get(c) is not None else None for c in ("lat", "lon"))
    points = ring or ([{"lat": lat, "lon": lon}] if lat is not None and lon is not None else [])
    lats, lons = [p["lat"] for p in points], [p["lon"] for p in points]
    box = [f(v) if points else None for f, v in ((min, lats), (min, lons), (max, lats), (max, lons))]
    number = thing.get("id")
    return {"file": path, "at": at, "kind": kind, "id": int(number) if number is not None and re.fullmatch(r"-?\d+", str(number)) else None, "tags": [(k, text_of(v)) for k, v in tags.items()] if tags is not None else None, "lat": lat, "lon": lon, "ring": ring, **dict(zip(BOX, box))}


class BoxedReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.split = options["path"].split("\n"), int(options.get("splitbytes", SPLIT_BYTES))
        self.most, self.pushed, self.whole = int(options.get("most", 0)), [], True

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            if len(f.attribute) == 1 and f.attribute[0] in BOX and (type(f) in COMPARE or isinstance(f, ds.IsNotNull)):
                self.pushed.append((f.attribute[0], COMPARE.get(type(f)), getattr(f, "value", None)))
            elif not isinstance(f, ds.IsNotNull):
                self.whole = False  # Spark drops more rows later, so a range can't stop early
                yield f
            else:
                yield f

    def partitions(self) -> list[Range]:
        return [Range(name, a, min(a + self.split, size), size) for path in self.paths for name, size in files_of(path) for a in range(0, size, self.split)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        rows, taken = [], 0
        for at, thing in objects(part.path, part.start, part.stop, part.size):
            row = row_of(part.path, at, thing)
            if all(row[c] is not None and (test is None or test(row[c], value)) for c, test, value in self.pushed):
                rows.append(row)
                taken += 1
            if len(rows) == ROWS:
                yield pa.RecordBatch.from_pylist(rows, ARROW)
                rows = []
            if self.most and self.whole and taken == self.most:
                break
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


class BoxedSource(ds.DataSource):
    """Format ``boxed_json``: options path (or paths, one a line), splitBytes, most (rows of a request)."""

    @classmethod
    def name(cls) -> str:
        return "boxed_json"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BoxedReader:
        return BoxedReader(dict(self.options))


def scan(spark: SparkSession, path: str | list[str], bbox: tuple[float, float, float, float] | None = None, most: int | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Rows of collections, of a box (south, west, north, east) if given, the first ``most`` of them by file and offset."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BoxedSource)
    options = {"path": path if isinstance(path, str) else "\n".join(path), "splitBytes": str(split_bytes)} | ({"most": str(most)} if most else {})
    rows = spark.read.format("boxed_json").options(**options).load()
    if bbox is not None:
        south, west, north, east = map(float, bbox)
        rows = rows.where((F.col("south") <= north) & (F.col("north") >= south) & (F.col("west") <= east) & (F.col("east") >= west))
    return rows.orderBy("file", "at").limit(most) if most else rows


def write_features(rows: DataFrame, path: str) -> None:
    """One feature collection a task: rows have ``properties`` (a map) and ``ring`` (lat, lon); an empty task writes an empty collection."""
    place = F.transform("ring", lambda p: F.array(p["lon"], p["lat"]))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(place).alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("properties"), geometry.alias("geometry")), {"ignoreNullFields": "false"})

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(['{"type":"FeatureCollection","features":['])], ["value"])
        ahead = ""
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                out.append(ahead + text)
                ahead = ","
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]}"])], ["value"])

    rows.select(feature.alias("value")).mapInArrow(lines, "value string").write.text(path)
