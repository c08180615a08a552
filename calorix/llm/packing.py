"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A document is its ids and an end id.  It is cut into pieces whose lengths fit
reciprocals of the capacity: whole capacities first; a rest of which
k = capacity // rest pieces fill a bin up to the slack stays whole, of others the
capacity's (k + 1)-th part is cut off.  Pieces with the same k are of one class,
and every bin of class k takes exactly k of them, whatever their lengths.  Each
task fills its own bins, so nothing is shuffled and a lost task is repeated
alone.  What a task has left at its end (less than a bin of each class) is laid end
to end and cut at the capacity, the last rest at powers of two, which need no padding.

Defined results: a null or empty text has its end id only; texts of any length
are encoded whole; repeated and null doc_ids are documents apiece; an empty
table gives no pieces; other columns, of any name, are kept in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calorix.llm.bpe import default_path
from calorix.llm.shared import strings, trimmed
from calorix.llm.tokens import bulk_encoder
from calorix.llm.words import slices

CAPACITY, END_ID = 2048, 1
#: A bin that is filled by its class may be short by this share of the capacity.
SLACK = 1 / 32
#: Bytes of text encoded at once, and pieces handed on at once.
TEXT_BYTES, PIECES = 1 << 23, 2000
PIECE = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def piece_lengths(n: int, capacity: int, slack: float) -> list[tuple[int, int]]:
    """(length, pieces in a bin of its class) of the pieces that n tokens are cut into, in order."""
    out, rest = [(capacity, 1)] * (n // capacity), n % capacity
    while rest:
        k = capacity // rest
        if capacity - k * rest <= slack * capacity:
            return [*out, (rest, k)]
        part = capacity // (k + 1)
        out.append((part, capacity // part))
        rest -= part
    return out


class Bins:
    """One task's open bins by class, and the pieces of the full ones in order."""

    def __init__(self, capacity: int, slack: float, task: int):
        self.capacity, self.slack, self.next = capacity, slack, task << 33
        self.open: dict[int, list[tuple]] = {}
        self.full: list[tuple] = []

    def add(self, row: pa.Array, ids: np.ndarray) -> None:
        start = 0
        for length, k in piece_lengths(len(ids), self.capacity, self.slack):
            held = self.open.setdefault(k, [])
            held.append((row, start, ids[start : start + length].tobytes(), len(ids)))
            if len(held) == k:
                self.close(self.open.pop(k))
            start += length

    def close(self, pieces: list[tuple]) -> None:
        """One sequence of the pieces."""
        at = 0
        for row, start, ids, tokens in pieces:
            self.full.append((row, start, len(ids) // 4, ids, tokens, self.next, at))
            at += len(ids) // 4
        self.next += 1

    def finish(self) -> None:
        """Sequences of what is left in open bins."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        total, room, held = sum(len(p[2]) // 4 for p in left), 0, []
        for row, start, ids, tokens in left:
            while ids:
                if not room:  # the next sequence's length
                    room = min(self.capacity, 1 << (total.bit_length() - 1)) if total < self.capacity else self.capacity
                n = min(room, len(ids) // 4)
                held.append((row, start, ids[: 4 * n], tokens))
                ids, start, room, total = ids[4 * n :], start + n, room - n, total - n
                if not room:
                    self.close(held)
                    held = []
        assert not held

    def batch(self, least: int) -> Iterator[pa.RecordBatch]:
        """The full sequences' pieces, once there are enough."""
        if len(self.full) > least:
            rows, *rest = zip(*self.full)
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["row", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            self.full = []
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(rows), *(pa.array(c, k) for c, k in zip(rest, kinds))], names)


def pack(docs: DataFrame, path: str, text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, slack: float = SLACK) -> DataFrame:
    """One row a piece: row (the document's other columns), start, length, ids (little-endian, 4 bytes each), doc_tokens, sequence_id, offset.

    The pieces of a sequence follow each other, by offset.  ``capacity`` is a power of two.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"), F.col(text).cast("string").alias("text"))

    @trimmed
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, bins, end = bulk_encoder(path), Bins(capacity, slack, TaskContext.get().partitionId()), np.array([end_id], np.int32)
        for part in slices(batches, most=TEXT_BYTES):
            for i, ids in enumerate(encoder.encode(strings(part.column("text")))):
                bins.add(part.column("row").take(pa.array([i])), np.concatenate([ids, end]))
                yield from bins.batch(PIECES)
        bins.finish()
        yield from bins.batch(0)

    return kept.mapInArrow(fill, f"row {kept.schema['row'].dataType.simpleString()}, {PIECE}")


def padding(length: Column, capacity: int = CAPACITY) -> Column:
    """Padding of a sequence of so many tokens: none at a power of two."""
    return F.when(F.bit_count(length) == 1, F.lit(0)).otherwise(capacity - length)


def sequences(pieces: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """sequence_id, length and padded ids of every sequence; a group is a sequence, of at most ``capacity`` tokens."""
    whole = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids", "length"))).alias("p"))
    total = F.aggregate("p", F.lit(0).cast("long"), lambda n, p: n + p["length"])
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda b, p: F.concat(b, p["ids"]))
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), padding(total, capacity).cast("int")))
    return whole.select("sequence_id", total.alias("length"), F.concat(joined, pad).alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the pieces of every document and where they are packed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pieces = pack(docs, default_path())
    return pieces.select("row.doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
