"""SimHash near-dedup by meet-in-the-middle ball hashing.

Fingerprints of 64 bits from 3-word shingles.  Every distinct fingerprint emits
all variants within half the radius; two fingerprints within the radius share a
variant.  Variants are shuffled; a variant's bucket holds at most as many
distinct fingerprints as the half ball has points (65 for radius 2), whatever
the number of documents.  All in a bucket are within the radius of each other
by the triangle inequality, so linking each to the bucket's least loses nothing;
each such pair is deduplicated and verified.

Defined results: a text without words (null, empty, blank) has fingerprint zero,
linked like any other; equal fingerprints are one class; the component id is the
least doc_id (null ids never count); repeated rows share their component; extra
columns pass through the stage; an empty table gives an empty result.

The pipeline's stage (``drop_similar``) goes by the texts instead: documents are
linked whose sets of five-word shingles have a similarity (intersection over
union) of 0.8 or more.  Candidates share a half-ball variant of one of several
short SimHashes of independent bits; the number and length of these follow from
the number of texts and the share of pairs to be found (``tables_for``).  Variants
travel as messages: a block of texts sends each owner (a range of buckets) its
sorted, Golomb-coded variants.  Of the pairs that meet there
and whose sketches (SKETCH bits) are very near an owner keeps a spanning forest.  Texts
with less near ones of other trees it names with the buckets where they meet those;
once more dealt by owner, with their long SimHashes, they give a forest of the pairs whose
long ones are near as well.  Both forests make clusters, in which all near pairs that
meet somewhere lie; an owner writes each of its texts once or twice and no pairs of a
group.  Each text is verified with the nearest and
the least it is kept with, which makes groups.
In a cluster of more than one group all pairs of other groups with near long SimHashes
are then tested, by blocks: a task holds two blocks of a cluster (about BLOCK texts and
BLOCK_BYTES bytes each), skips what it knows to be linked, and returns links alone.
Blocks of one large group do not meet each other.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calorix.llm.components import components
from calorix.llm.golomb_dedup import golomb_decode, golomb_encode
from calorix.llm.shared import BROADCAST_ROWS, folded, materialise, one_of_each, text_digest, trimmed

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Shingles whose bits are counted at once, so that long texts need bounded memory.
BITS_AT_ONCE = 65_536
#: The stage's rule: words of a shingle and least similarity of near copies.
STAGE_SHINGLE, SIMILARITY = 5, 0.8
#: Share of the pairs of just that similarity that may not meet in any table.
MISSED = 0.03
#: Texts whose variants are sent together.
NODES_AT_ONCE = 8192
#: Texts and bytes of text of a block that meets the other blocks of its cluster.
BLOCK, BLOCK_BYTES = 1024, 8 << 20
#: Bits of the long SimHash that messages carry (its first 32 and its last), and differing ones up to which a pair is in one cluster without a look at the rest (one unrelated pair in 100 000).
SKETCH, SURE = 48, 9
#: Members of a bucket up to which all its pairs are compared at once.
SMALL_BUCKET = 8
#: Standard deviations above the expected differing bits at which a pair is no candidate.
SLACK = 3.5


def fingerprint(text: bytes) -> int:
    """The majority bits of the XXH64 of all shingles of an A-Z lower-cased text."""
    words = text.split()  # of bytes: at space and 0x09-0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = [0, *(e + 1 for e in ends[:-SHINGLE])]
    prints = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])], ">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(prints), BITS_AT_ONCE):
        ones += np.unpackbits(prints[at : at + BITS_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(prints)).tobytes(), "big")


def fingerprints(docs: DataFrame, *also: Column) -> DataFrame:
    """doc_id and print (the fingerprint as a long), and other columns of longs."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *also)
    names = ["doc_id", "print", *rows.columns[2:]]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_buffer().to_pybytes()) for t in folded(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), *batch.columns[2:]], names)

    return rows.mapInArrow(sketch, ", ".join(f"{n} long" for n in names))


def half_ball(radius: int) -> list[int]:
    """The 64-bit masks (as signed) of all variants within half the radius."""
    if radius % 2:
        raise ValueError("the radius must be even: buckets of half balls hold pairs within twice the half")
    masks = [sum(1 << b for b in bits) for n in range(radius // 2 + 1) for bits in combinations(range(64), n)]
    return [m - 2**64 if m >= 2**63 else m for m in masks]


def linked(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v) links of distinct fingerprints whose components are those of all pairs within the radius."""
    variants = prints.select("print", F.explode(F.array(*[F.col("print").bitwiseXOR(F.lit(m).cast("long")) for m in half_ball(radius)])).alias("variant"))
    # A window's bucket is bounded by the half ball: the prints are distinct.
    least = F.min("print").over(Window.partitionBy("variant"))
    pairs = variants.withColumn("v", least).where("print <> v").select(F.col("print").alias("u"), "v").distinct()
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)


def near_groups(docs: DataFrame, radius: int = RADIUS, *also: Column) -> DataFrame:
    """doc_id, print, other columns, component (its least print) and component_id of every row."""
    known = materialise(fingerprints(docs, *also), "prints")
    distinct = materialise(known.groupBy("print").agg(F.min("doc_id").alias("least_id")), "distinct-prints")
    found = components(linked(distinct.select("print"), radius)).withColumnRenamed("node", "print")
    placed = distinct.join(found, "print", "left").withColumn("component", F.coalesce("component", "print"))
    ids = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_print = placed.join(ids, "component").select("print", "component", "component_id")
    return known.join(of_print, "print").select(*known.columns, "component", "component_id")


def drop_near(docs: DataFrame) -> DataFrame:
    """One row of each group stays: of the least doc_id (null comes last), then the least digest."""
    return one_of_each(docs, near_groups(docs, RADIUS, text_digest()), "component", F.min)


def differing(similarity: float) -> float:
    """The chance that a SimHash bit differs between two sets of equal size and this similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def most_bits(bits: int, similarity: float) -> int:
    """Differing bits, of so many, that pairs of the similarity hardly ever exceed."""
    p = differing(similarity)
    return math.floor(bits * p + SLACK * math.sqrt(bits * p * (1 - p)))


def tables_for(texts: int, similarity: float) -> tuple[int, int]:
    """Number and bits of the short SimHashes: buckets hold about one unrelated text, and at most MISSED of the pairs meet in none."""
    bits = min(30, max(16, math.ceil(math.log2(max(texts, 1))) + 4))
    p = differing(similarity)
    met = sum(math.comb(bits, n) * p**n * (1 - p) ** (bits - n) for n in range(3))
    return math.ceil(math.log(MISSED) / math.log(1 - met)), bits


def shingles(text: bytes, size: int) -> np.ndarray:
    """The sorted distinct XXH64 of a lower-cased text's shingles; shorter texts are one shingle, blank ones none."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-size])]
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])], np.uint64))


def wide_print(hashes: np.ndarray, longs: int) -> np.ndarray:
    """Majority bits (64 for each long) of the hashes, mixed anew for each long."""
    ones, steps = np.zeros(64 * longs, np.int64), np.arange(1, longs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), BITS_AT_ONCE // longs):
        x = hashes[at : at + BITS_AT_ONCE // longs, None] + steps
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1).sum(0, dtype=np.int32)
    return 2 * ones > len(hashes)


def sketches(docs: DataFrame, size: int, tables: int, bits: int) -> DataFrame:
    """doc_id, digest, node (32 SimHash bits before 32 of the set's hash), tables (the short SimHashes) and print (all bits) of every row."""
    longs = -(-(SKETCH + tables * bits) // 64)
    weights = 1 << np.arange(bits, dtype=np.int64)

    @trimmed
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, short, prints = [], [], []
            for text in folded(batch.column(2)):
                hashes = shingles(text.as_buffer().to_pybytes(), size)
                found = wide_print(hashes, longs)
                prints.append(np.packbits(found).tobytes())
                nodes.append(int.from_bytes(prints[-1][:4] + xxhash.xxh32_digest(hashes.tobytes(), SEED), "big", signed=True))
                short.append((found[32 : 32 + tables * bits].reshape(tables, bits) @ weights).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(short, pa.list_(pa.int64())), pa.array(prints, pa.binary())], ["doc_id", "digest", "node", "tables", "print"]
            )

    return docs.select(F.col("doc_id").cast("long"), text_digest(), F.col("text").cast("string")).mapInArrow(sketch, "doc_id long, digest long, node long, tables array<long>, print binary")


def matrix(prints: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The prints' bits, a row of unsigned longs each."""
    return np.frombuffer(b"".join(prints.to_pylist()), np.uint64).reshape(len(prints), -1)


def short_sketches(prints: pa.Array) -> np.ndarray:
    """SKETCH bits of each print, a row of bytes: its first 32 bits and its last, none of which are a table's."""
    rows = matrix(prints).view(np.uint8)
    return np.concatenate([rows[:, :4], rows[:, 4 - SKETCH // 8 :]], axis=1)


def as_longs(sketches: np.ndarray) -> np.ndarray:
    return np.pad(sketches, ((0, 0), (0, 8 - SKETCH // 8))).view(np.uint64)[:, 0]


def packed_ids(ids: np.ndarray) -> bytes:
    """Sorted ids: their gaps, all low bytes first, compressed."""
    return zlib.compress(np.diff(ids, prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked_ids(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view(np.int64)[:, 0])


def bucket_messages(nodes: DataFrame, tables: int, bits: int, owner_bits: int) -> DataFrame:
    """Each block's variants to the owners of their buckets: coded buckets, numbers of the texts, and the bits and ids (``groups``) of the texts that occur.

    A text's variants that differ in low bits share an owner, so that it occurs in
    about 1 + owner_bits messages a table, not in those of all owners.
    """
    masks = np.array([0, *(1 << b for b in range(bits))], np.int64)
    width = (tables - 1).bit_length() + bits

    @trimmed
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            sketch = short_sketches(batch.column("print"))
            short = batch.column("tables").flatten().to_numpy().reshape(-1, tables)
            edges = sorted({*range(0, len(ids), NODES_AT_ONCE), len(ids)})
            for a, b in zip(edges, edges[1:]):
                buckets = (((np.arange(tables) << bits)[None, :, None] + (short[a:b, :, None] ^ masks)).reshape(b - a, -1)).astype(np.uint64)
                places = np.repeat(np.arange(b - a, dtype="<u2"), buckets.shape[1])
                order = np.argsort(buckets, axis=None, kind="stable")
                keys, places = buckets.reshape(-1)[order], places[order]
                owner = (keys >> np.uint64(max(width - owner_bits, 0))).astype(np.int64)
                low = np.flatnonzero(np.diff(owner, prepend=-1))
                rows = []
                for x, y in zip(low, np.append(low[1:], len(keys))):
                    # The texts of this message alone, numbered anew.
                    own, place = np.unique(places[x:y], return_inverse=True)
                    known = packed_ids(ids[a:b][own])
                    start = int(owner[x]) << max(width - owner_bits, 0)
                    k = max(1, (2 ** max(width - owner_bits, 0) // int(y - x)).bit_length())
                    rows.append((int(owner[x]), start, int(y - x), k, *golomb_encode(keys[x:y] - np.uint64(start), k), place.astype("<u2").tobytes(), sketch[a:b][own].tobytes(), known))
                kinds = pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["owner", "start", "n", "k", "quotients", "remainders", "places", "sketches", "groups"])

    schema = "owner int, start long, n int, k int, quotients binary, remainders binary, places binary, sketches binary, groups binary"
    return nodes.select("id", "tables", "print").mapInArrow(send, schema)


class Forest:
    """Trees of numbered texts: an edge is taken if it joins two of them."""

    def __init__(self, n: int):
        self.above = list(range(n))

    def root(self, i: int) -> int:
        above = self.above
        while above[i] != i:
            above[i] = i = above[above[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.above[max(i, j)] = min(i, j)
        return i != j


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def spanning(members: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """Edges that span the near pairs of one bucket, found outward from its first member."""
    left, edges = members, []
    while len(left):
        found, left = [left[0]], left[1:]
        while found and len(left):
            here = found.pop()
            close = near(left, np.full(1, here))
            edges.append(np.stack([left[close], np.full(close.sum(), here)], axis=1))
            found += left[close].tolist()
            left = left[~close]
    return edges


def forest_of(edges: list[np.ndarray], differ: Callable[[np.ndarray, np.ndarray], np.ndarray], trees: Forest) -> np.ndarray:
    """The edges that join trees, the nearest first: those are the likeliest to be similar, and owners mostly choose the same."""
    edges = np.unique(np.sort(np.concatenate([np.zeros((0, 2), np.int64), *edges]), axis=1), axis=0)
    edges = edges[np.lexsort((edges[:, 1], edges[:, 0], differ(edges[:, 0], edges[:, 1])))]
    return np.array([(a, b) for a, b in edges.tolist() if trees.join(a, b)], np.int64).reshape(-1, 2)


def candidates(nodes: DataFrame, tables: int, bits: int, similarity: float) -> DataFrame:
    """What owners find of the ids that meet in a bucket, in rows of two kinds.

    (u, v, apart: their differing sketch bits) without members are the edges of a forest
    of the pairs of at most SURE such bits.  A row with members is a tree v: its texts (u)
    that may be similar to texts of other trees, and the buckets where they meet those.
    """
    most = most_bits(SKETCH, similarity)
    owner_bits = min((tables - 1).bit_length() + bits, (2 * int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        buckets, ids, sketches, at, known = [], [], [], [], 0
        for r in table.to_pylist():
            buckets.append(golomb_decode(r["n"], r["k"], r["quotients"], r["remainders"]) + np.uint64(r["start"]))
            ids.append(unpacked_ids(r["groups"]))
            sketches.append(as_longs(np.frombuffer(r["sketches"], np.uint8).reshape(-1, SKETCH // 8)))
            at.append(np.frombuffer(r["places"], "<u2").astype(np.int64) + known)
            known += len(ids[-1])
        # Numbers in the order of ids: a text of several messages has one.
        ids, number = np.unique(np.concatenate(ids), return_inverse=True)
        kept = np.zeros(len(ids), np.uint64)
        kept[number] = np.concatenate(sketches)
        buckets, sketches, at = np.concatenate(buckets), kept, number[np.concatenate(at)]
        order = np.lexsort((at, buckets))
        buckets, at = buckets[order], at[order]
        firsts = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1]))
        sizes = np.diff(np.append(firsts, len(at)))
        first, small = np.repeat(firsts, sizes), np.repeat(sizes <= SMALL_BUCKET, sizes)
        large = [slice(f, f + n) for f, n in zip(firsts[sizes > SMALL_BUCKET], sizes[sizes > SMALL_BUCKET])]
        differ = lambda a, b: apart(sketches[a], sketches[b])

        def beside_each_other() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Places of the two of each pair of the small buckets."""
            for k in range(1, SMALL_BUCKET):
                here = np.flatnonzero(small[k:] & (first[k:] <= np.arange(len(at) - k))) + k
                yield here, here - k

        edges = []
        for x, y in beside_each_other():
            near = differ(at[x], at[y]) <= SURE
            edges.append(np.stack([at[x[near]], at[y[near]]], axis=1))
        for m in large:
            edges += spanning(at[m], lambda a, b: differ(a, b) <= SURE)
        trees = Forest(len(ids))
        sure = forest_of(edges, differ, trees)
        tree = np.array([trees.root(i) for i in range(len(ids))])
        unsettled = np.zeros(len(at), bool)  # places where a text meets one that may be similar, of another tree
        may_be = lambda a, b: (tree[a] != tree[b]) & (differ(a, b) <= most)
        for x, y in beside_each_other():
            near = may_be(at[x], at[y])
            unsettled[x[near]] = unsettled[y[near]] = True
        for m in large:
            members, marks = at[m], unsettled[m]
            for i in range(1, len(members)) if (tree[members] != tree[members[0]]).any() else ():
                near = may_be(members[:i], members[i])
                marks[:i] |= near
                marks[i] |= near.any()
        open_at, open_buckets = at[unsettled], buckets[unsettled]
        order = np.lexsort((open_at, tree[open_at]))
        open_at, open_buckets = open_at[order], open_buckets[order].astype(np.int64)
        text_starts = np.flatnonzero(np.diff(open_at, prepend=-1))
        texts = open_at[text_starts]
        starts = np.flatnonzero(np.diff(tree[texts], prepend=-1))
        roots = tree[texts[starts]]
        grouped = lambda starts, values: pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values)
        members = grouped(starts, pa.StructArray.from_arrays([pa.array(ids[texts]), grouped(text_starts, pa.array(open_buckets))], ["u", "buckets"]))
        return pa.table(
            {
                "owner": pa.array(np.full(len(sure) + len(roots), key[0].as_py()), pa.int32()),
                "u": np.concatenate([ids[sure[:, 1]], ids[roots]]),
                "v": np.concatenate([ids[sure[:, 0]], ids[roots]]),
                "apart": np.concatenate([differ(sure[:, 0], sure[:, 1]).astype(np.int32), np.zeros(len(roots), np.int32)]),
                "members": pa.chunked_array([pa.nulls(len(sure), members.type), members]),
            }
        )

    sent = bucket_messages(nodes, tables, bits, owner_bits)
    return sent.groupBy("owner").applyInArrow(meet, "owner int, u long, v long, apart int, members array<struct<u:long,buckets:array<long>>>")


def settled(unsettled: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(u, v, apart) of ids that join an owner's trees: a forest of the pairs of its unsettled texts (owner, v: its tree, u, buckets) that share a bucket and whose sketches and prints differ in no more bits than those of similar texts do."""

    def settle(table: pa.Table) -> pa.Table:
        table = table.sort_by("u").combine_chunks()
        ids, prints = table.column("u").to_numpy(), matrix(table.column("print"))
        sketches = as_longs(short_sketches(table.column("print")))
        differ = lambda a, b: apart(sketches[a], sketches[b])
        most, most_all = most_bits(SKETCH, similarity), most_bits(64 * prints.shape[1], similarity)

        def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            a, b = np.broadcast_arrays(a, b)
            close = differ(a, b) <= most
            close[close] = apart(prints[a[close]], prints[b[close]]).sum(1, dtype=np.int32) <= most_all
            return close

        trees = Forest(len(ids))
        _, first, tree = np.unique(table.column("v").to_numpy(), return_index=True, return_inverse=True)
        for i, f in enumerate(first[tree].tolist()):
            trees.join(i, f)
        lists = table.column("buckets").combine_chunks()
        at, buckets = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        order = np.lexsort((at, buckets))
        at, buckets = at[order], buckets[order]
        edges = []
        for members in np.split(at, np.flatnonzero(buckets[1:] != buckets[:-1]) + 1):
            edges += spanning(members, near)
        pairs = forest_of(edges, differ, trees)
        return pa.table({"u": ids[pairs[:, 1]], "v": ids[pairs[:, 0]], "apart": differ(pairs[:, 0], pairs[:, 1]).astype(np.int32)})

    whole = unsettled.join(nodes.select(F.col("id").alias("u"), "print"), "u")
    return whole.groupBy("owner").applyInArrow(settle, "u long, v long, apart int")


def beside(pairs: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """Pairs (u, v) with the value of both."""
    rest = [c for c in pairs.columns if c not in "uv"]
    for node in "uv":
        pairs = pairs.join(values.select(F.col("id").alias(node), F.col(value).alias(f"{value}_{node}")), node)
    return pairs.select("u", "v", *rest, f"{value}_u", f"{value}_v")


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have that much in common: intersection over union."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def verified(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs whose texts' sets of shingles are that similar."""

    @trimmed
    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = []
            for i in range(batch.num_rows):
                x, y = (shingles(folded(batch.column(c).slice(i, 1))[0].as_buffer().to_pybytes(), size) for c in (2, 3))
                stays.append(similar(x, y, similarity))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(stays, pa.bool_()))

    return materialise(beside(pairs.select("u", "v"), texts, "text").mapInArrow(exact, "u long, v long"), "near-links")


def texts_of(nodes: DataFrame, pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, text) of all texts in some pair."""
    asked = pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id"))).distinct()
    asked = materialise(nodes.join(asked, "id", "left_semi").select("id", "row.*"), "near-nodes").withColumnsRenamed({"digest": "__digest", "doc_id": "__id"})
    few = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    texts = docs.select(F.col("doc_id").cast("long"), text_digest(), F.col("text").cast("string"))
    met = texts.join(few, (texts["digest"] == few["__digest"]) & texts["doc_id"].eqNullSafe(few["__id"]))
    return materialise(met.select("id", "text").dropDuplicates(["id"]), "near-texts")  # rows that repeat id and text


def in_blocks(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (id, group, cluster, bytes; clusters of several groups) with their pack, part and slot, and the pairs of such blocks that are to meet.

    A pack is a large cluster, or small ones together; a group of BLOCK or more texts
    is a part of its own, whose blocks meet those of the other parts only.
    """
    n, size = (x or 0 for x in members.agg(F.count(F.lit(1)), F.sum("bytes")).first())
    packs = 1 + max(n // BLOCK, size // BLOCK_BYTES)
    of_cluster = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    small = -1 - F.pmod(F.xxhash64("cluster"), F.lit(packs))  # ids are never negative
    packed = members.join(of_cluster, "cluster").withColumn("pack", F.when(F.col("n") < BLOCK // 8, small).otherwise(F.col("cluster"))).drop("n")
    large = packed.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= BLOCK).select("group", F.col("group").alias("part"))
    parted = packed.join(large, "group", "left").withColumn("part", F.coalesce("part", F.lit(-1)))
    slots = parted.groupBy("pack", "part").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES), F.lit(1)).alias("slots"))
    placed = materialise(parted.join(slots, ["pack", "part"]).select("id", "group", "pack", "part", F.pmod(F.xxhash64("id"), "slots").alias("slot")), "blocks")
    blocks = placed.select("pack", F.struct("part", "slot").alias("a")).distinct()
    meet = blocks.join(blocks.withColumnRenamed("a", "b"), "pack").where("a <= b and not (a.part = b.part and a.part >= 0)")
    return placed, meet


def across_groups(near: DataFrame, links: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links (u, v) that join the groups of ``links`` within the clusters of ``near``: every near pair of other groups is tested, save those that found links join already."""
    of = lambda pairs, name: components(pairs.select("u", "v")).select(F.col("node").alias("id"), F.col("component").alias(name))
    members = of(near, "cluster").join(of(links, "group"), "id", "left").withColumn("group", F.coalesce("group", "id"))
    several = members.groupBy("cluster").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi").select("cluster")
    members = materialise(members.join(several, "cluster").join(texts.select("id", F.octet_length("text").alias("bytes")), "id"), "cluster-members")
    placed, meet = in_blocks(members)
    side = lambda c, second: F.struct(F.col(f"{c}.part").alias("part"), F.col(f"{c}.slot").alias("slot"), F.lit(second).alias("second"))
    sides = meet.select("pack", "a", "b", F.inline(F.when(F.col("a") == F.col("b"), F.array(side("a", False))).otherwise(F.array(side("a", False), side("b", True)))))
    whole = materialise(placed.join(nodes.select("id", "print"), "id").join(texts, "id"), "block-texts")
    shared = sides.join(whole, ["pack", "part", "slot"]).select("pack", "a", "b", "second", "id", "group", "print", "text")

    def test(table: pa.Table) -> pa.Table:
        table = table.sort_by([("second", "ascending"), ("id", "ascending")])
        n, ids, prints, texts = table.num_rows, table.column("id").to_numpy(), matrix(table.column("print")), table.column("text")
        _, first, group = np.unique(table.column("group").to_numpy(), return_index=True, return_inverse=True)
        trees, found, most = Forest(n), [], most_bits(64 * prints.shape[1], similarity)
        for i, f in enumerate(first[group].tolist()):
            trees.join(i, f)
        sets = [shingles(t.as_buffer().to_pybytes(), size) for chunk in texts.chunks for t in folded(chunk)]
        sizes = np.array([len(x) for x in sets])
        ends, of = np.append(0, np.cumsum(sizes)), np.repeat(np.arange(n), sizes)
        values, codes = np.unique(np.concatenate(sets), return_inverse=True)
        here = np.zeros(len(values), bool)
        second = np.flatnonzero(table.column("second").to_numpy())
        for i in range(second[0] if len(second) else n):
            start = second[0] if len(second) else i + 1
            near = start + np.flatnonzero(apart(prints[start:], prints[i]).sum(1, dtype=np.int32) <= most)
            root = trees.root(i)
            near = np.array([j for j in near.tolist() if trees.root(j) != root], np.int64)
            if len(near):
                mine = codes[ends[i] : ends[i + 1]]
                here[mine] = True
                both = np.bincount(of[ends[start] :][here[codes[ends[start] :]]], minlength=n)[near]
                here[mine] = False
                for j in near[both >= similarity * (sizes[i] + sizes[near] - both) - 1e-9].tolist():
                    if trees.join(i, j):
                        found.append((ids[i], ids[j]))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"u": pairs.max(1), "v": pairs.min(1)})

    return materialise(shared.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pack", "a", "b").groupBy("pack", "a", "b").applyInArrow(test, "u long, v long"), "near-links")


def similar_groups(docs: DataFrame, size: int = STAGE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, digest and component of every row: rows whose texts are that similar, by one or more steps, share it."""
    tables, bits = tables_for(docs.count(), similarity)
    known = materialise(sketches(docs, size, tables, bits), "sketches")
    # Of rows with equal sets of shingles any will do: they are one node.
    nodes = known.groupBy("node").agg(F.min(F.struct("digest", "doc_id")).alias("row"), F.min("tables").alias("tables"), F.min("print").alias("print"))
    nodes = materialise(nodes.withColumn("id", F.monotonically_increasing_id()), "sketch-nodes")
    met = materialise(candidates(nodes, tables, bits, similarity), "candidates", NODES_AT_ONCE)
    found = met.where("members is null").select("u", "v", "apart").union(settled(met.where("members is not null").select("owner", "v", F.inline("members")), nodes, similarity))
    near = materialise(found.groupBy("u", "v").agg(F.first("apart").alias("apart")), "near-pairs")
    texts = texts_of(nodes, near, docs)
    # Of each text the pair with the nearest and with the least, so that groups are found by pairs as few as the texts.
    first = near.groupBy("u").agg(F.min("v").alias("least"), F.min_by("v", F.struct("apart", "v")).alias("nearest"))
    links = verified(first.select("u", F.explode(F.array_distinct(F.array("least", "nearest"))).alias("v")), texts, size, similarity)
    found = components(links.union(across_groups(near, links, nodes, texts, size, similarity)))
    of_node = nodes.select("node", "id").join(found.withColumnRenamed("node", "id"), "id", "left").select("node", F.coalesce("component", "id").alias("component"))
    return known.select("doc_id", "digest", "node").join(of_node, "node").select("doc_id", "digest", "component")


def drop_similar(docs: DataFrame, size: int = STAGE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of similar texts stays: of the least doc_id (null comes last), then the least digest."""
    return one_of_each(docs, materialise(similar_groups(docs, size, similarity), "near-groups"), "component", F.min)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: fingerprint and component of every document."""
    groups = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
