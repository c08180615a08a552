"""LM scoring with a hierarchical Pitman-Yor model of words in the context of the word before.

Every word (and the start of a text) has a context restaurant of the words that
follow it; all of them share one parent, the restaurant of words without context;
its base measure spells words: a hierarchy of byte-context restaurants, in which
every context shares the restaurant of its shorter context as parent.  A table of
a restaurant is a customer of its parent.  The events are those of the unigram
base: the words of the lexicon and one for any word outside it, whose probability
is what the word restaurant and the spelling leave for words not in the lexicon.
Spelling contexts are the last byte, a class (of 32) of the byte before and a class
(of 8) of the one before that, so the spelling has a proven size.

Seating is sampled by Gibbs on the numbers of tables, with the sizes of tables
summed out.  Of a dish with c customers, t tables have the probability
S(c, t) * a^t up to a factor, S being generalised Stirling numbers and a the
discount times the base probability times x; x is an auxiliary Gamma variable of
the restaurant with shape strength / discount + all its tables.  Given x the
dishes are independent, so a sweep draws all tables of all dishes and then x anew;
nothing else is carried from sweep to sweep.  Draws are exact up to EXACT customers
of a dish; above, their law is taken from the saddle point.  Predictions of words
and spelling are averaged over samples; those in context take the mean number of
tables of each pair given x.

Counts of pairs cover the whole training corpus and are never collected.  Texts
are cut into blocks (a table bucketed by block, so that it is never shuffled).  Of
its distinct pairs a block sends every owner (a range of key hashes) sorted,
Golomb-coded keys with their counts; owners answer with the total of each pair and
name one block that stands for it in sums.  Words ask the lexicon by their hashes.  A pair's
key has 20 bits more than the corpus has tokens, so that a pair is taken for
another with a probability of 2^-20 at any size; words have keys of 64 bits.

Defined results: null, empty and blank texts are an end only; words are compared
after lower-casing A-Z; a null doc_id is not held out; repeated rows get equal
results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calorix.llm.golomb_dedup import golomb_decode, golomb_encode
from calorix.llm.shared import TEXTS_AT_ONCE, cut, drop_step, few_rows_a_batch, folded, materialise, shared_dir, shuffles_dropped, trimmed

#: Bytes of the context: the last one exactly, classes of those before.
CLASSES_2, CLASSES_3 = 32, 8
PER_BYTE = CLASSES_2 * CLASSES_3
SPELL_DISCOUNT, SPELL_STRENGTH = 0.7, 1.0
WORD_STRENGTH = 10.0
#: Sweeps before and while predictions are averaged, and rounds between words and spelling.
BURN_IN, SAMPLES, ROUNDS = 3, 4, 2
#: Strength of the context restaurants.
PAIR_STRENGTH = 1.0
#: Bytes of text in a block, and blocks in an Arrow batch.
BLOCK_BYTES, BLOCKS_AT_ONCE = 6 << 20, 2
#: Words in an Arrow batch.
WORDS_AT_ONCE = 10_000
#: Bits of a pair's key beyond those that number the tokens.
SPARE_BITS = 20
#: Customers of a dish up to which its tables are drawn from the exact law.
EXACT = 256
END = b""
END_HASH = np.uint64(xxhash.xxh64_intdigest(END, 42))


def held_out(doc_id: F.Column) -> F.Column:
    """Whether a document is kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def many_tables(customers: np.ndarray, a: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the tables beyond the first of dishes with many customers, by the saddle point of S(c, t) * a^t."""
    low, high = np.zeros(len(a)), np.ones(len(a))  # a * (1 - u) * u^(discount - 1) falls from infinity to 0 and is c at the saddle
    for _ in range(60):
        u = (low + high) / 2
        above = a * (1 - u) * u ** (discount - 1) > customers
        low, high = np.where(above, u, low), np.where(above, high, u)
    u = np.maximum((low + high) / 2, 1e-300)
    mean = a * (1 - u**discount) / discount
    # The variance is the mean's slope in log a, which moves u as well.
    slope = (1 - u) / ((1 - u) * (discount - 1) - u)
    return mean, mean + a * u**discount * slope


def laws(customers: np.ndarray, a: np.ndarray, discount: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the dishes with 2 to EXACT customers: their places, and rows of the probabilities of 1, 2, ... tables, up to a factor."""
    some = np.flatnonzero((customers > 1) & (customers <= EXACT))
    some = some[np.argsort(customers[some], kind="stable")]
    counts, logs = customers[some], np.log(np.maximum(a[some], 1e-300))
    stirling, at = np.zeros(1), 0  # log S(n, 1..n)
    for n in range(2, int(counts[-1]) + 1 if len(counts) else 0):
        stay = stirling + np.log(n - 1 - discount * np.arange(1, n))
        stirling = np.append(np.logaddexp(stay, np.append(-np.inf, stirling[:-1])), stirling[-1])
        end = np.searchsorted(counts, n, "right")
        step = max(1, (1 << 20) // n)
        for start in range(at, end, step):
            mine = slice(start, min(start + step, end))
            law = stirling + np.arange(1, n + 1) * logs[mine, None]
            yield some[mine], np.exp(law - law.max(1, keepdims=True))
        at = end


def draw_tables(customers: np.ndarray, a: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes, each drawn with a probability in proportion to S(c, t) * a^t."""
    tables = np.minimum(customers, 1).astype(np.int64)
    many = np.flatnonzero(customers > EXACT)
    if len(many):
        mean, variance = many_tables(customers[many], a[many], discount)
        few = variance > 0.9 * mean
        more = np.where(few, rng.poisson(mean), np.rint(rng.normal(mean, np.sqrt(np.maximum(variance, 0)))))
        tables[many] = np.clip(1 + more, 1, customers[many])
    for at, law in laws(customers, a, discount):
        law = np.cumsum(law, axis=1)
        pick = rng.random(len(law)) * law[:, -1]
        tables[at] = 1 + np.minimum((law <= pick[:, None]).sum(1), law.shape[1] - 1)
    return tables


def mean_tables(customers: np.ndarray, a: np.ndarray, discount: float) -> np.ndarray:
    """The mean of what ``draw_tables`` draws."""
    tables = np.minimum(customers, 1).astype(float)
    many = np.flatnonzero(customers > EXACT)
    if len(many):
        tables[many] = np.clip(1 + many_tables(customers[many], a[many], discount)[0], 1, customers[many])
    for at, law in laws(customers, a, discount):
        tables[at] = law @ np.arange(1, law.shape[1] + 1) / law.sum(1)
    return tables


def draw_strength(tables: np.ndarray | float, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """The auxiliary variable of restaurants with so many tables, times the discount."""
    return discount * rng.gamma(strength / discount + tables)


class SpellingTree:
    """The restaurants of all contexts that end in one byte."""

    def __init__(self, rows: np.ndarray, dishes: np.ndarray, customers: np.ndarray):
        self.fine, self.dishes, self.customers = rows, dishes, customers  # fine: context row, 0 to 255
        self.tables = np.minimum(customers, 1)

    @staticmethod
    def level(customers: np.ndarray, tables: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """Predictions of restaurants (rows) for all dishes from their parents' predictions."""
        n, t = customers.sum(1, keepdims=True), tables.sum(1, keepdims=True)
        back = SPELL_STRENGTH + SPELL_DISCOUNT * t
        return (customers - SPELL_DISCOUNT * tables + back * parent) / (SPELL_STRENGTH + n)

    def sample(self, root: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Averaged predictions (256 contexts x 256 dishes) and the tables that are the root's customers."""
        shape = CLASSES_2 * CLASSES_3, 256
        c3, t3 = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        c3[self.fine, self.dishes], t3[self.fine, self.dishes] = self.customers, self.tables
        c2 = t3.reshape(CLASSES_2, CLASSES_3, 256).sum(1)
        t2 = np.minimum(c2, 1)
        c1 = t2.sum(0, keepdims=True)
        t1 = np.minimum(c1, 1)
        mean = np.zeros(shape)
        for sweep in range(BURN_IN + SAMPLES):
            p1 = self.level(c1, t1, root[None])
            p2 = self.level(c2, t2, p1)
            for c, t, parent in ((c3, t3, np.repeat(p2, CLASSES_3, 0)), (c2, t2, np.repeat(p1, CLASSES_2, 0)), (c1, t1, root[None])):
                row, dish = at = np.nonzero(c)
                x = draw_strength(t.sum(1), SPELL_DISCOUNT, SPELL_STRENGTH, rng)
                t[at] = draw_tables(c[at], x[row] * parent[row, dish], SPELL_DISCOUNT, rng)
                if c is c3:
                    c2[:] = t3.reshape(CLASSES_2, CLASSES_3, 256).sum(1)
                    t2 = np.minimum(np.maximum(t2, c2 > 0), c2)
                elif c is c2:
                    c1[:] = t2.sum(0, keepdims=True)
                    t1 = np.minimum(np.maximum(t1, c1 > 0), c1)
            if sweep >= BURN_IN:
                p2 = self.level(c2, t2, self.level(c1, t1, root[None]))
                mean += self.level(c3, t3, np.repeat(p2, CLASSES_3, 0)) / SAMPLES
        return mean, t1[0]


def spell(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and dish of every byte of the words and their ends, and where each word starts."""
    text = np.frombuffer(b"".join(b"   " + w + b" " for w in words), np.uint8).astype(np.int64)
    sizes = np.array([len(w) + 1 for w in words])
    starts = np.cumsum(sizes) - sizes
    places = np.arange(sizes.sum()) + 3 * (np.repeat(np.arange(len(words)), sizes) + 1)
    context = (text[places - 1] * CLASSES_2 + text[places - 2] % CLASSES_2) * CLASSES_3 + text[places - 3] % CLASSES_3
    return context, text[places], starts


class Spelling:
    """log10 predictions of all contexts; contexts of a last byte that was never seen share block 0, the root's."""

    def __init__(self, root: np.ndarray, blocks: dict[int, np.ndarray]):
        self.block = np.zeros(256, np.int64)
        self.block[list(blocks)] = np.arange(1, len(blocks) + 1)
        first = np.tile(np.log10(root).astype(np.float32), (1, PER_BYTE, 1))
        self.logs = np.concatenate([first, *(b[None] for b in blocks.values())])

    def score(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each word's bytes and end."""
        if not words:
            return np.zeros(0)
        context, dish, starts = spell(words)
        return np.add.reduceat(self.logs[self.block[context // PER_BYTE], context % PER_BYTE, dish].astype(float), starts)


def spelling_counts(lexicon: DataFrame) -> DataFrame:
    """(cell, n): how often the words' tables use each dish in each context; cells are bounded by 256 * PER_BYTE * 256."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, tables = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            if words:
                context, dish, starts = spell(words)
                cells, inverse = np.unique(context * 256 + dish, return_inverse=True)
                sizes = np.diff(np.append(starts, len(context)))
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.bincount(inverse, np.repeat(tables, sizes)).astype(np.int64))], ["cell", "n"])

    return lexicon.select("word", "t").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def learn_spelling(lexicon: DataFrame, root: np.ndarray, seed: int) -> tuple[Spelling, np.ndarray]:
    """The spelling (of bounded size) and the root's new prediction."""

    def sample(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        cells = group["cell"].to_numpy()
        tree = SpellingTree(cells // 256 % PER_BYTE, cells % 256, group["n"].to_numpy())
        mean, tables = tree.sample(root, np.random.default_rng([seed, int(key[0])]))
        return pd.DataFrame({"byte": [key[0]], "logs": [np.log10(mean).astype(np.float32).tobytes()], "tables": [tables.tolist()]})

    cells = spelling_counts(lexicon).withColumn("byte", F.floor(F.col("cell") / (PER_BYTE * 256)).cast("int"))
    cells = cells.repartition(int(lexicon.sparkSession.conf.get("spark.sql.shuffle.partitions")), "byte")  # little data, much work
    rows = cells.groupBy("byte").applyInPandas(sample, "byte int, logs binary, tables array<long>").collect()  # at most 256 rows
    spelling = Spelling(root, {r["byte"]: np.frombuffer(r["logs"], np.float32).reshape(PER_BYTE, 256) for r in rows})
    customers = np.sum([r["tables"] for r in rows], axis=0, dtype=np.int64)
    flat, rng = np.full(256, 1 / 256), np.random.default_rng(seed)
    tables, mean = np.minimum(customers, 1), np.zeros(256)
    for sweep in range(BURN_IN + SAMPLES):
        tables = draw_tables(customers, draw_strength(tables.sum(), SPELL_DISCOUNT, SPELL_STRENGTH, rng) * flat, SPELL_DISCOUNT, rng)
        if sweep >= BURN_IN:
            mean += SpellingTree.level(customers[None], tables[None], flat[None])[0] / SAMPLES
    return spelling, mean


LEXICON = "word binary, h long, c long, n long, t double, spelling double"


def spelled(lexicon: DataFrame, logs) -> DataFrame:
    """The lexicon (word, h, c, n, t) with the log10 probability of each word's bytes."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logs.value.score(batch.column(0).to_pylist()))], [*batch.schema.names, "spelling"])

    return lexicon.select("word", "h", "c", "n", F.col("t").cast("double").alias("t")).mapInArrow(score, LEXICON)


def drawn(batch: pa.RecordBatch, strength: float, discount: float, seed: int) -> np.ndarray:
    """One draw of the tables of a batch's words (n customers, spelling)."""
    counts, spelling = batch.column("n").to_numpy().astype(np.int64), batch.column("spelling").to_numpy()
    rng = np.random.default_rng([seed, len(counts), int(counts.sum()), int(abs(spelling.sum()) * 1e6)])
    return draw_tables(counts, strength * 10.0**spelling, discount, rng)


def sweep_words(words: DataFrame, strength: float, discount: float, seed: int) -> float:
    """All tables of the word restaurant in one sweep."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(drawn(batch, strength, discount, seed).sum())])], ["t"])

    return words.select("n", "spelling").mapInArrow(sweep, "t long").agg(F.sum("t")).first()[0] or 0


def seat_words(words: DataFrame, discount: float, total: float, pair_discount: float, seed: int) -> DataFrame:
    """The words with the mean of their tables over samples and x of their context restaurants; the word restaurant's total is renewed by every sweep."""
    rng, kept = np.random.default_rng(seed), []
    for sweep in range(BURN_IN + SAMPLES):
        kept.append((float(draw_strength(total, discount, WORD_STRENGTH, rng)), seed * 1000 + sweep))
        if sweep + 1 < BURN_IN + SAMPLES:
            total = sweep_words(words, kept[-1][0], discount, kept[-1][1])
    kept = kept[-SAMPLES:]

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = np.mean([drawn(batch, strength, discount, at) for strength, at in kept], axis=0)
            own = batch.column("t").to_numpy()
            x = draw_strength(own, pair_discount, PAIR_STRENGTH, np.random.default_rng([seed, len(own), int(own.sum())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tables), pa.array(x)], [*batch.schema.names, "tables", "x"])

    return words.mapInArrow(sample, f"{LEXICON}, tables double, x double")


def bucketed(df: DataFrame, name: str, rows: int = BLOCKS_AT_ONCE) -> DataFrame:
    """A step that is joined by block: an external table in the shared folder, bucketed by block, so that joins don't shuffle it; rows: of an Arrow batch."""
    spark, key = df.sparkSession, uuid.uuid4().hex
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with few_rows_a_batch(spark, rows), shuffles_dropped(spark):
        df.write.format("parquet").bucketBy(buckets, "block").sortBy("block").option("path", f"{shared_dir(spark)}/{name}-{key}").saveAsTable(f"{name}_{key}")
    return spark.table(f"{name}_{key}")


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64)


def packed(values: np.ndarray, kind: str) -> bytes:
    """Numbers as bytes; those that are mostly small are compressed, single-precision ones are not."""
    data = values.astype(kind).tobytes()
    return data if kind == "<f4" else zlib.compress(data, 1)


def unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(data if kind == "<f4" else zlib.decompress(data), kind)


def blocks_of(docs: DataFrame, learns: Column) -> DataFrame:
    """Texts as blocks: doc ids, whether each teaches, ends of their tokens, tokens as numbers of the block's words (sorted by hash), and training counts."""

    @trimmed
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, teach, flat, ends, size = TaskContext.get().partitionId() << 32, [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            coded = pa.array(flat, pa.binary()).dictionary_encode()
            words, numbers = coded.dictionary, coded.indices.to_numpy()
            order = np.argsort(hashes_of(words.to_pylist()))
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            tokens = rank[numbers]
            counts = np.bincount(tokens[np.repeat(np.array(teach, bool), np.diff(ends, prepend=0))], minlength=len(order))
            rows = [[block], [ids], [teach], [ends], [packed(tokens, "<i4")], [words.take(pa.array(order))], [counts.tolist()]]
            kinds = pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], ["block", "ids", "learns", "ends", "tokens", "words", "counts"])

        for batch in batches:
            for rows in cut(batch, "text", BLOCK_BYTES):
                for doc_id, text, one in zip(rows.column(0).to_pylist(), folded(rows.column(1)), rows.column(2).to_pylist()):
                    flat += text.as_buffer().to_pybytes().split()
                    flat.append(END)
                    ids.append(doc_id)
                    teach.append(bool(one))
                    ends.append(len(flat))
                    size += text.as_buffer().size
                    if size >= BLOCK_BYTES:
                        yield flush()
                        block, ids, teach, flat, ends, size = block + 1, [], [], [], [], 0
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(learns, F.lit(False)).alias("learns"))
    schema = "block long, ids array<long>, learns array<boolean>, ends array<int>, tokens binary, words array<binary>, counts array<long>"
    return bucketed(rows.mapInArrow(make, schema), "blocks")


class Block:
    """A block's words and distinct pairs."""

    def __init__(self, row: dict):
        self.ids, self.learns = row["ids"], np.array(row["learns"], bool)
        self.ends = np.array(row["ends"])
        self.tokens = unpacked(row["tokens"], "<i4").astype(np.int64)
        self.hashes = hashes_of(row["words"])
        before = np.roll(self.tokens, 1)
        before[np.append(0, self.ends[:-1])] = np.searchsorted(self.hashes, END_HASH)
        self.codes = before * len(self.hashes) + self.tokens  # of the pair that ends at each token
        self.distinct = np.unique(self.codes)
        self.first, self.second = self.distinct // len(self.hashes), self.distinct % len(self.hashes)

    def training_counts(self) -> np.ndarray:
        codes, n = np.unique(self.codes[np.repeat(self.learns, np.diff(self.ends, prepend=0))], return_counts=True)
        counts = np.zeros(len(self.distinct), np.int64)
        counts[np.searchsorted(self.distinct, codes)] = n
        return counts

    def keys(self, bits: int) -> np.ndarray:
        """The pairs' keys."""
        x = self.hashes[self.first] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[self.second]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) >> np.uint64(64 - bits)

    def take(self, answers: list[dict], bits: int) -> None:
        """Totals of the pairs, and whether this block stands for them, from the owners' answers."""
        order = np.argsort(self.keys(bits), kind="stable")
        self.totals, self.stands = np.zeros(len(order), np.int64), np.zeros(len(order), bool)
        self.totals[order] = np.concatenate([unpacked(a["totals"], "<u4") for a in answers])
        self.stands[order] = np.concatenate([np.unpackbits(np.frombuffer(a["stands"], np.uint8))[: a["n"]] for a in answers]).astype(bool)


MESSAGE = "block long, owner int, n int, k int, quotients binary, remainders binary"


def coded(block: int, keys: np.ndarray, bits: int, owner_bits: int, counts: np.ndarray | None = None) -> list[tuple]:
    """One message to each owner that has some of the sorted keys; the first owner_bits of a key name its owner."""
    owner, rows = (keys >> np.uint64(bits - owner_bits)).astype(np.int64), []
    low = np.flatnonzero(np.diff(owner, prepend=-1))
    for a, b in zip(low, np.append(low[1:], len(keys))):
        if bits == 64:  # words: their keys are too far apart for a code to pay
            rows.append((block, int(owner[a]), int(b - a), 0, keys[a:b].tobytes(), b""))
            continue
        mine = keys[a:b] - (np.uint64(owner[a]) << np.uint64(bits - owner_bits))
        k = max(1, min(62, (2 ** (bits - owner_bits) // int(b - a)).bit_length() - 1))
        rows.append((block, int(owner[a]), int(b - a), k, *golomb_encode(mine, k), *([] if counts is None else [packed(counts[a:b], "<u4")])))
    return rows


def as_batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split() for f in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def pair_answers(blocks: DataFrame, bits: int, owner_bits: int) -> DataFrame:
    """(block, answers, once, twice): totals of its pairs by owner, and how many of those it stands for occur once and twice."""
    schema = f"{MESSAGE}, counts binary"

    @trimmed
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = Block(row)
                keys = own.keys(bits)
                order = np.argsort(keys, kind="stable")
                yield as_batch(coded(row["block"], keys[order], bits, owner_bits, own.training_counts()[order]), schema)

    reply = "block long, owner int, n int, totals binary, stands binary, once long, twice long"

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = np.concatenate([golomb_decode(r["n"], r["k"], r["quotients"], r["remainders"]) for r in rows])
        _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        totals = np.bincount(inverse, np.concatenate([unpacked(r["counts"], "<u4") for r in rows])).astype(np.int64)
        stands = np.zeros(len(keys), bool)
        stands[first[totals > 0]] = True
        out, at = [], 0
        for r in rows:
            t, s = totals[inverse[at : at + r["n"]]], stands[at : at + r["n"]]
            out.append((r["block"], r["owner"], r["n"], packed(t, "<u4"), np.packbits(s).tobytes(), int((t[s] == 1).sum()), int((t[s] == 2).sum())))
            at += r["n"]
        return pa.Table.from_batches([as_batch(out, reply)])

    sent = blocks.select("block", "ids", "learns", "ends", "tokens", "words").mapInArrow(send, schema)
    answered = sent.groupBy("owner").applyInArrow(answer, reply)
    return bucketed(
        answered.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("owner", "n", "totals", "stands"))).alias("answers"), F.sum("once").alias("once"), F.sum("twice").alias("twice")), "pair_answers"
    )


def word_questions(blocks: DataFrame, owner_bits: int) -> DataFrame:
    """Each block's word hashes to the owners of their ranges; they are asked more than once."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield as_batch(coded(row["block"], hashes_of(row["words"]), 64, owner_bits), MESSAGE)

    return materialise(blocks.select("block", "words").mapInArrow(send, MESSAGE), "word-questions", BLOCKS_AT_ONCE)


def word_answers(questions: DataFrame, lexicon: DataFrame, values: dict[str, str], owner_bits: int) -> DataFrame:
    """(block, <name>: packed values of its words in order); NaN or 0 for words that the lexicon hasn't.  values: name to number format."""

    names = list(values)
    reply = ", ".join(["block long, owner int", *(f"{n} binary" for n in names)])

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        hashes = known["h"].to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        hashes, out = hashes[order], []
        for r in asked.to_pylist():
            keys = np.frombuffer(r["quotients"], np.uint64)
            at = np.minimum(np.searchsorted(hashes, keys), max(len(hashes) - 1, 0))
            there = hashes[at] == keys if len(hashes) else np.zeros(len(keys), bool)
            found = []
            for n in names:
                column = np.zeros(len(keys)) if n == "c" else np.full(len(keys), np.nan)
                if len(hashes):
                    column[there] = known[n].to_numpy()[order][at[there]]
                found.append(packed(column, values[n]))
            out.append((r["block"], r["owner"], *found))
        return pa.Table.from_batches([as_batch(out, reply)])

    owned = lexicon.select("h", *[F.col(n).cast("double").alias(n) for n in names], F.shiftrightunsigned("h", 64 - owner_bits).cast("int").alias("owner"))
    answered = questions.groupBy("owner").cogroup(owned.groupBy("owner")).applyInArrow(answer, reply)
    of_block = answered.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("owner", *names))).alias("rows"))
    return bucketed(of_block.select("block", *[F.transform("rows", lambda r: r[n]).alias(n) for n in names]), "word_answers", TEXTS_AT_ONCE)


def joined_values(row: dict, name: str, kind: str) -> np.ndarray:
    """A block's word values from all owners."""
    return np.concatenate([unpacked(x, kind) for x in row[name]]).astype(float)


def first_sums(blocks: DataFrame, pairs: DataFrame, bits: int) -> DataFrame:
    """The lexicon (word, h, c, n, t): training count, number of contexts and number of successors of every word; each pair has one table."""

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                own = Block(row)
                own.take(row["answers"], bits)
                n, t = (np.bincount(side[own.stands], minlength=len(own.hashes)) for side in (own.second, own.first))
                c = np.array(row["counts"])
                some = np.flatnonzero(c + n + t)
                words = batch.column("words")[i].values.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([words.cast(pa.binary()), pa.array(c[some]), pa.array(n[some]), pa.array(t[some])], ["word", "c", "n", "t"])

    rows = blocks.join(pairs.select("block", "answers"), "block").mapInArrow(count, "word binary, c long, n long, t long")
    return rows.groupBy("word").agg(*[F.sum(x).alias(x) for x in "cnt"]).withColumn("h", F.xxhash64("word"))


def next_sums(blocks: DataFrame, pairs: DataFrame, values: DataFrame, bits: int, discount: float, seed: int) -> DataFrame:
    """(h, n, t): sums of the drawn tables of each word's pairs over contexts, and of their mean over successors."""

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own, rng = Block(row), np.random.default_rng([seed, row["block"]])
                own.take(row["answers"], bits)
                at = np.flatnonzero(own.stands)
                first, second, c = own.first[at], own.second[at], own.totals[at]
                a = weights(row, first, second)
                n = np.bincount(second, draw_tables(c, a, discount, rng), len(own.hashes))
                t = np.bincount(first, mean_tables(c, a, discount), len(own.hashes))
                some = np.flatnonzero(n + t)
                yield pa.RecordBatch.from_arrays([pa.array(own.hashes[some].view(np.int64)), pa.array(n[some]), pa.array(t[some])], ["h", "n", "t"])

    rows = blocks.drop("counts").join(pairs.select("block", "answers"), "block").join(values, "block").mapInArrow(count, "h long, n double, t double")
    return rows.groupBy("h").agg(F.sum("n").cast("long").alias("n"), F.sum("t").alias("t"))


def weights(row: dict, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """a of pairs: the context's x (times the discount) and the parent's probability of the word."""
    return np.nan_to_num(joined_values(row, "x", "<f4"))[first] * 10.0 ** np.nan_to_num(joined_values(row, "logp", "<f4"), nan=-30.0)[second]


@dataclass
class Fit:
    """What scoring needs: tables by block and word, and numbers."""

    blocks: DataFrame
    questions: DataFrame
    pairs: DataFrame
    drawn_with: DataFrame  #: word answers of the last sweep of pairs
    lexicon: DataFrame  #: word, h, c, t (mean tables of its context restaurant), logp (as parent)
    n: int
    types: int
    discount: float  #: of the context restaurants
    unknown: float  #: log10 probability, as parent, of a word that is not in the lexicon
    bits: int
    owner_bits: int


def estimated_discount(once: int, twice: int) -> float:
    return min(max(once / (once + 2 * twice), 0.1), 0.9) if once and twice else 0.5


def seated_words(lexicon: DataFrame, root: np.ndarray, pair_discount: float, seed: int) -> tuple[DataFrame, float, np.ndarray]:
    """The lexicon with logp (the word restaurant's averaged prediction) and x (of the word's context restaurant), the unknown word's log10, and the root's new prediction."""
    spark = lexicon.sparkSession
    n, types, once, twice = lexicon.agg(F.sum("n"), F.count(F.lit(1)), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    discount = estimated_discount(once, twice)
    spelling, root = learn_spelling(lexicon.select("word", F.lit(1).cast("long").alias("t")), root, seed)
    spread = spark.sparkContext.broadcast(spelling)  # at most 256 blocks of 256 KB
    words = materialise(spelled(lexicon, spread), "spelled-words", WORDS_AT_ONCE)
    spread.unpersist()
    seated = materialise(seat_words(words, discount, float(types), pair_discount, seed), "lexicon", WORDS_AT_ONCE)
    drop_step(words)
    total, mass = seated.agg(F.sum("tables"), F.sum(F.pow(F.lit(10.0), "spelling"))).first()
    back = WORD_STRENGTH + discount * total
    prediction = F.log10((F.col("n") - discount * F.col("tables") + back * F.pow(F.lit(10.0), "spelling")) / (WORD_STRENGTH + n))
    found = seated.select("word", "h", "c", "t", prediction.alias("logp"), "x")
    return found, math.log10(back / (WORD_STRENGTH + n) * max(1 - mass, 1e-6)), root


def fit(docs: DataFrame, learns: Column) -> Fit:
    """Count, seat and draw: words in context, words and spelling in turn."""
    spark = docs.sparkSession
    blocks = blocks_of(docs, learns)
    tokens = blocks.agg(F.sum(F.element_at("ends", -1))).first()[0] or 0
    bits = min(62, max(40, int(tokens).bit_length() + SPARE_BITS))
    owner_bits = max(1, (2 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    pairs = pair_answers(blocks, bits, owner_bits)
    questions = word_questions(blocks, owner_bits)
    once, twice = (x or 0 for x in pairs.agg(F.sum("once"), F.sum("twice")).first())
    discount = estimated_discount(once, twice)
    lexicon = materialise(first_sums(blocks, pairs, bits), "lexicon-sums")
    n, types = (x or 0 for x in lexicon.agg(F.sum("c"), F.count(F.lit(1))).first())
    root, unknown = np.full(256, 1 / 256), 0.0
    if not n:
        lexicon = lexicon.selectExpr("word", "h", "c", "double(t) t", "double(0) logp", "double(1) x")
        return Fit(blocks, questions, pairs, word_answers(questions, lexicon, {"x": "<f4", "logp": "<f4"}, owner_bits), lexicon, n, types, discount, unknown, bits, owner_bits)
    for r in range(ROUNDS):
        sums = lexicon
        lexicon, unknown, root = seated_words(sums, root, discount, r)
        drop_step(sums)
        if r + 1 < ROUNDS:
            values = word_answers(questions, lexicon, {"x": "<f4", "logp": "<f4"}, owner_bits)
            sums = next_sums(blocks, pairs, values, bits, discount, r)
            seated, lexicon = lexicon, materialise(lexicon.select("word", "h", "c").join(sums, "h", "left").select("word", "h", "c", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("t", F.lit(0.0)).alias("t")), "lexicon-sums")
            drop_step(seated)
    return Fit(blocks, questions, pairs, values, lexicon, n, types, discount, unknown, bits, owner_bits)


def scored(model: Fit) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of all texts of the fit's blocks, those that taught and others."""
    last = word_answers(model.questions, model.lexicon, {"c": "<f8", "t": "<f4", "logp": "<f4"}, model.owner_bits).withColumnRenamed("logp", "parent")
    below, bits, discount, unknown = model.n + 0.5 * (model.types + 1), model.bits, model.discount, model.unknown

    @trimmed
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = Block(row)
                own.take(row["answers"], bits)
                c, t, parent = (joined_values(row, name, kind) for name, kind in (("c", "<f8"), ("t", "<f4"), ("parent", "<f4")))
                t, p = np.nan_to_num(t), 10.0 ** np.nan_to_num(parent, nan=unknown)
                seats = own.totals - discount * mean_tables(own.totals, weights(row, own.first, own.second), discount)
                pair = np.log10((seats + (PAIR_STRENGTH + discount * t)[own.first] * p[own.second]) / (PAIR_STRENGTH + c)[own.first])
                starts = np.append(0, own.ends[:-1])
                sums = lambda x: np.add.reduceat(x, starts)  # noqa: B023, E731
                known, base = c > 0, np.log10((c + 0.5) / below)
                columns = [pa.array(own.ids, pa.int64()), pa.array(own.ends - starts), pa.array(sums(known[own.tokens].astype(np.int64))), pa.array(sums(base[own.tokens])), pa.array(sums(pair[np.searchsorted(own.distinct, own.codes)]))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    rows = model.blocks.drop("counts").join(model.pairs.select("block", "answers"), "block").join(model.drawn_with, "block").join(last, "block")
    with few_rows_a_batch(rows.sparkSession, BLOCKS_AT_ONCE):
        return materialise(rows.mapInArrow(score, "doc_id long, n_tokens long, n_known long, base_score double, score double"), "scores")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: scores of every document under a model of those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, ~held_out(F.col("doc_id")))
    return scored(model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(int(model.n)).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
