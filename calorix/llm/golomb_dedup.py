"""Exact dedup by a Golomb-coded fingerprint exchange.

1. One pass over the texts makes a 64-bit fingerprint and a SHA-256 of each
   normalised text (A-Z lower-cased, null as empty).
2. Each partition sends every owner (a range of fingerprints) its distinct
   fingerprints, sorted and Golomb coded, with a bit for those it holds twice.
   So the owner of a hot fingerprint gets it once from each partition, never
   once per copy.
3. Owners answer each message with a bitmap of the duplicates among them.
4. Only documents under such a bit are suspects; their texts are shuffled and
   compared byte by byte.

Defined results: a null text equals an empty one; of equal texts the row with
the largest doc_id stays (rows that repeat one doc_id are one document and share
their flags; if all ids of a group are null, its rows stay); an empty table
gives an empty result; extra columns are ignored by the query and kept by the
stage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calorix.llm.shared import fold, folded, materialise, one_of_each, semi_or_anti

#: Owners for each shuffle partition: more owners make smaller groups.
OWNERS_PER_PARTITION = 2


def golomb_encode(values: np.ndarray, k: int) -> tuple[bytes, bytes]:
    """Ascending uint64 values as gaps with divisor 2**k: unary quotients and k-bit remainders."""
    gaps = np.diff(values, prepend=np.uint64(0))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + len(values), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
    remainders = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return np.packbits(unary).tobytes(), np.packbits(remainders).tobytes()


def golomb_decode(n: int, k: int, unary: bytes, remainders: bytes) -> np.ndarray:
    """The values of ``golomb_encode``."""
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotients = (np.diff(ends, prepend=-1) - 1).astype(np.uint64)
    bits = np.unpackbits(np.frombuffer(remainders, np.uint8))[: n * k].reshape(n, k)
    low = np.zeros(n, np.uint64)
    for column in range(k):
        low = (low << np.uint64(1)) | bits[:, column]
    return np.cumsum((quotients << np.uint64(k)) + low, dtype=np.uint64)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (long) and SHA-256 of every normalised text."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_buffer() for t in folded(batch.column(1))]
            prints = np.array([xxhash.xxh64_intdigest(t, 42) for t in texts], np.uint64)
            shas = [hashlib.sha256(t).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), pa.array(shas, pa.string())], ["doc_id", "print", "text_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(digest, "doc_id long, print long, text_sha256 string")


def messages(prints: DataFrame, owners: int) -> DataFrame:
    """One row for each partition and owner: sorted, Golomb-coded distinct fingerprints, and a bit for each that repeats here."""
    width = 2**64 // owners

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = TaskContext.get().partitionId()
        parts = [b.column(0).to_numpy().view(np.uint64) for b in batches]
        if not parts:
            return
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        owner = np.minimum(values // np.uint64(width), np.uint64(owners - 1)).astype(np.int64)
        rows = []
        for one in np.unique(owner):
            low, high = np.searchsorted(owner, [one, one + 1])
            mine = values[low:high] - np.uint64(int(one) * width)
            k = max(1, min(63, int(width / len(mine)).bit_length() - 1))
            rows.append((source, int(one), len(mine), k, *golomb_encode(mine, k), np.packbits(counts[low:high] > 1).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
            ["source", "owner", "n", "k", "quotients", "remainders", "repeats"],
        )

    return prints.select("print").mapInArrow(send, "source int, owner int, n int, k int, quotients binary, remainders binary, repeats binary")


def bitmaps(sent: DataFrame) -> DataFrame:
    """Each owner's answers: for every message a bitmap of the fingerprints that occur more than once anywhere."""

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        lists = [golomb_decode(r.n, r.k, r.quotients, r.remainders) for r in group.itertuples()]
        here = [np.unpackbits(np.frombuffer(r.repeats, np.uint8))[: r.n].astype(bool) for r in group.itertuples()]
        values, inverse, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        twice = counts > 1
        twice[inverse[np.concatenate(here)]] = True
        flags = np.split(twice[inverse], np.cumsum([len(x) for x in lists])[:-1])
        return pd.DataFrame({"source": group.source, "owner": group.owner, "bitmap": [np.packbits(x).tobytes() for x in flags]})

    return sent.groupBy("owner").applyInPandas(answer, "source int, owner int, bitmap binary")


def suspect_prints(sent: DataFrame, owners: int) -> DataFrame:
    """Sources match the answers with what they sent: the fingerprints that are not unique."""
    width = 2**64 // owners

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for r in batch.to_pylist():
                flags = np.unpackbits(np.frombuffer(r["bitmap"], np.uint8))[: r["n"]].astype(bool)
                if flags.any():
                    found.append(golomb_decode(r["n"], r["k"], r["quotients"], r["remainders"])[flags] + np.uint64(r["owner"] * width))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["print"])

    answered = sent.drop("repeats").join(bitmaps(sent), ["source", "owner"])
    return answered.mapInArrow(receive, "print long").distinct()


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, print, keep_id, group_size, kept and text_sha256 of every row."""
    spark = docs.sparkSession
    owners = OWNERS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = materialise(digests(docs), "digests")
    sent = materialise(messages(known, owners), "messages")
    prints = materialise(suspect_prints(sent, owners), "suspects")
    n_prints = prints.count()
    suspects = semi_or_anti(known, prints, "print", "left_semi", n_prints)
    suspects = materialise(suspects.select("doc_id").distinct(), "suspect-docs")
    texts = semi_or_anti(docs.select(F.col("doc_id").cast("long"), "text"), suspects, "doc_id", "left_semi", suspects.count())
    classes = (
        texts.select("doc_id", fold(F.col("text")).alias("bytes"))
        .groupBy("bytes")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select(F.sha2("bytes", 256).alias("text_sha256"), "keep_id", "group_size", F.lit(True).alias("grouped"))
    )
    return known.join(classes, "text_sha256", "left").select(
        "doc_id",
        "print",
        F.when(F.col("grouped"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(F.col("grouped"), F.col("doc_id").eqNullSafe(F.col("keep_id"))).otherwise(True).alias("kept"),
        "text_sha256",
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    return grouped(docs).drop("print")


def drop_exact(docs: DataFrame) -> DataFrame:
    """One row of each text stays: of the largest doc_id (null comes last)."""
    copies = grouped(docs).where("group_size > 1").select("doc_id", F.col("print").alias("digest"), "text_sha256")
    return one_of_each(docs, copies, "text_sha256", F.max)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: exact groups of all documents."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT doc_id, sha256(t) AS text_sha256, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
