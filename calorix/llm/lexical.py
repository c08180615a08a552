"""Ranked lexical search with block-max pruning.

``build`` cuts the documents into blocks (ranges of a task's rows).  A block is one
row: its terms with, for each, the documents that hold it, the most occurrences
in one and the least length per occurrence; and a forward index of its documents.
``search`` bounds every query in every block by the terms' maxima and scores
forward-index blocks in the order of a query's bounds, in growing rounds, until
no bound reaches the query's k-th best score; it is exact.  A round's blocks come
from every task's highest bounds and go to all tasks as pairs of numbers; once
they are more than PAIRS, every task scores what is left by bounds of its own.  So
the index stays where it is.  A task reads BLOCKS_AT_ONCE blocks at once and holds
ROOM pairs of an occurrence and a query.  Queries are asked some megabytes at a
time, so that what goes to every task is bounded; only a query's best scores come back.

Defined results: documents without terms are no documents (they don't count and
are never found); null and repeated doc_ids are documents apiece, null after
others of an equal score; a query without known terms finds nothing; empty tables
give no rows; a long text is indexed whole; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calorix.llm.shared import few_rows_a_batch, materialise, trimmed
from calorix.llm.words import slices, words_of
from calorix.operators.prefix import running

#: Length normalisation in hundredths (b), saturation in thousandths (k1 in eighths of m).
B, UNIT = 90, 1_000_000_000
BEST = 10
#: Bytes of the texts in a block; bytes of the queries asked at once; blocks that a query scores in the first round.
BLOCK_BYTES, QUERY_BYTES, FIRST_BLOCKS = 1 << 18, 1 << 22, 4
#: Blocks that a task reads at once; pairs of a block and a query that go to every task; pairs of an occurrence and a query that a task holds (one document's at least).
BLOCKS_AT_ONCE, PAIRS, ROOM = 16, 1 << 17, 1 << 20
BLOCK = "block long, n_docs long, n_terms long, terms array<string>, df array<int>, most array<int>, thin array<double>, ids array<bigint>, sizes array<int>, ends array<int>, codes array<int>, tfs array<int>"
INT = pa.int32()


def blocks_of(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a block of documents with terms: its terms' maxima and its forward index."""
    kept = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))

    @trimmed
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=BLOCK_BYTES):
            words, doc = words_of(part.column("text"))
            if not len(words):
                continue
            encoded = words.dictionary_encode()
            n, code = len(encoded.dictionary), encoded.indices.to_numpy().astype(np.int64)
            pairs, tf = np.unique(doc * n + code, return_counts=True)
            doc, code = pairs // n, pairs % n
            size = np.bincount(doc, weights=tf).astype(np.int64)
            held = np.flatnonzero(size)
            most, thin = np.zeros(n, np.int32), np.full(n, np.inf)
            np.maximum.at(most, code, tf)
            np.minimum.at(thin, code, size[doc] / tf)
            lists = [encoded.dictionary, pa.array(np.bincount(code, minlength=n), INT), pa.array(most), pa.array(thin), part.column("id").take(pa.array(held)), pa.array(size[held], INT), pa.array(np.searchsorted(doc, held, "right"), INT), pa.array(code, INT), pa.array(tf, INT)]
            one = [pa.ListArray.from_arrays([0, len(a)], a) for a in lists]
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([len(held)]), pa.array([size.sum()]), *one], [c.split()[0] for c in BLOCK.split(", ")])

    return kept.mapInArrow(index, BLOCK).withColumn("block", F.monotonically_increasing_id())


def build(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The written index of all documents."""
    return materialise(blocks_of(docs, text, doc_id), "index", row_group=BLOCKS_AT_ONCE)


class Weights:
    """The weights of a set of queries' terms, and document scores by the corpus's length."""

    def __init__(self, queries: list[tuple[int, list[str]]], df: dict[str, int], n_docs: int, n_terms: int):
        self.n_docs, self.n_terms, self.n_queries = n_docs, n_terms, len(queries)
        self.terms = sorted({t for _, ts in queries for t in ts if t in df})
        number = {t: i for i, t in enumerate(self.terms)}
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in self.terms], np.int64)
        pairs = np.array([(number[t], q) for q, (_, ts) in enumerate(queries) for t in ts if t in number], np.int64).reshape(-1, 2)
        order = np.argsort(pairs[:, 0], kind="stable")
        self.query = pairs[order, 1]  # queries by term: those of term i are between at[i] and at[i + 1]
        self.at = np.searchsorted(pairs[order, 0], np.arange(len(self.terms) + 1))

    def known(self, terms: pa.Array) -> np.ndarray:
        """Number of each term, -1 for those of no query."""
        return pc.fill_null(pc.index_in(terms, value_set=pa.array(self.terms, pa.string())), -1).to_numpy()

    def spread(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into number, query) of every query of each term."""
        n = self.at[number + 1] - self.at[number]
        index = np.repeat(np.arange(len(number)), n)
        return index, self.query[np.repeat(self.at[number] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def part(self, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        """What one term gives a document, without its weight."""
        m = 100 - B + (B * size * self.n_docs) // self.n_terms
        return (UNIT * tf) // (1000 * tf + 8 * m)

    def bound(self, terms: pa.Array, most: np.ndarray, thin: np.ndarray) -> np.ndarray:
        """No document of a block with these maxima scores more, by query."""
        number = self.known(terms)
        hit = np.flatnonzero(number >= 0)
        # m is at least 99 - B + B * size * n_docs / n_terms, so that m / tf is least with the most tf and the least size / tf; 2 for rounding.
        part = np.floor(UNIT / (1000 + 8 * (99 - B) / most[hit] + 8 * B * (self.n_docs / self.n_terms) * thin[hit])).astype(np.int64) + 2
        index, query = self.spread(number[hit])
        out = np.zeros(self.n_queries, np.int64)
        np.add.at(out, query, (self.weight[number[hit]] * part)[index])
        return out

    def scores(self, terms: pa.Array, sizes: np.ndarray, ends: np.ndarray, codes: np.ndarray, tfs: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, document's place in the block, score) of all documents of a block that hold a term of these queries, some documents at a time."""
        asked = np.zeros(self.n_queries, bool)
        asked[queries] = True
        here = asked[self.query]
        query, at = self.query[here], np.concatenate([[0], np.cumsum(here)])[self.at]
        number = self.known(terms)
        times = np.where(number >= 0, np.diff(at)[number], 0) if len(self.terms) else np.zeros(len(number), np.int64)  # queries that ask for each term
        hit = np.flatnonzero(times[codes])
        doc, number, times = np.searchsorted(ends, hit, "right"), number[codes[hit]], times[codes[hit]]
        gain = self.weight[number] * self.part(tfs[hit].astype(np.int64), sizes[doc].astype(np.int64))
        ahead = np.cumsum(times) - times
        part = ahead[np.searchsorted(doc, doc)] // ROOM  # by the document's first occurrence, so that documents stay whole
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(hit)] if len(hit) else []
        for a, b in zip(edges, edges[1:]):
            n = times[a:b]
            asking = query[np.repeat(at[number[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            keys, inverse = np.unique(asking * len(sizes) + np.repeat(doc[a:b], n), return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, inverse, np.repeat(gain[a:b], n))
            yield keys // len(sizes), keys % len(sizes), total


class Pairs:
    """Pairs of a block and a query, by block."""

    def __init__(self, block: np.ndarray, query: np.ndarray):
        order = np.argsort(block, kind="stable")
        self.query = query[order].astype(np.int32)
        self.block, self.at = np.unique(block[order], return_index=True)
        self.at = np.append(self.at, len(order))

    def of(self, block: int) -> np.ndarray:
        """The queries of a block."""
        i = np.searchsorted(self.block, block)
        return self.query[self.at[i] : self.at[i + 1]] if i < len(self.block) and self.block[i] == block else self.query[:0]


class Found:
    """The best documents of each query that a task has seen, and for each query the score that others must reach."""

    def __init__(self, best: int, least: np.ndarray):
        self.best, self.least = best, least.copy()
        self.query, self.key, self.score, self.none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, query: np.ndarray, ids: pa.Array, score: np.ndarray) -> None:
        some = np.flatnonzero((score > 0) & (score >= self.least[query]))
        ids = ids.take(pa.array(some))
        query, score = np.concatenate([self.query, query[some]]), np.concatenate([self.score, score[some]])
        key, none = np.concatenate([self.key, ids.fill_null(0).to_numpy()]), np.concatenate([self.none, ids.is_null().to_numpy(zero_copy_only=False)])
        order = np.lexsort((key, none, -score, query))
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        order, last = order[place < self.best], order[place == self.best - 1]
        self.query, self.key, self.score, self.none = query[order], key[order], score[order], none[order]
        self.least[query[last]] = np.maximum(self.least[query[last]], score[last])

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.query, INT), pa.array(self.key, mask=self.none), pa.array(self.score)], ["query", "doc_id", "score"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array | int]]:
    """The blocks of all batches: lists as arrays."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].values if pa.types.is_list(batch.schema.field(c).type) else batch.column(c)[i].as_py() for c in batch.schema.names}


def _open(b: dict[str, pa.Array | int], weights: Weights, done: Pairs, least: np.ndarray) -> np.ndarray:
    """Every query's bound in a block, 0 where the pair is done or can't reach the query's least score."""
    found = weights.bound(b["terms"], b["most"].to_numpy(), b["thin"].to_numpy())
    found[done.of(b["block"])] = 0
    return np.where(found >= least, found, 0)


def _bounds(index: DataFrame, weights: Weights, most: int, done: Pairs, least: np.ndarray) -> DataFrame:
    """block, query and bound of each task's ``most`` highest bounds of each query, of pairs that aren't done and reach ``least``."""

    @trimmed
    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, at = (np.zeros((most, weights.n_queries), np.int64) for _ in range(2))
        for b in _rows(batches):
            found = _open(b, weights, done, least)
            some = np.flatnonzero(found > top.min(axis=0))
            low = top[:, some].argmin(axis=0)
            top[low, some], at[low, some] = found[some], b["block"]
        row, query = np.nonzero(top)
        yield pa.RecordBatch.from_arrays([pa.array(at[row, query]), pa.array(query, INT), pa.array(top[row, query])], ["block", "query", "bound"])

    return index.select("block", "terms", "most", "thin").mapInArrow(bound, "block long, query int, bound long")


def _frequencies(index: DataFrame, terms: list[str]) -> dict[str, int]:
    """Documents that hold each of the terms; those of none are left out."""

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, asked = np.zeros(len(terms), np.int64), pa.array(terms, pa.string())
        for b in _rows(batches):
            number = pc.fill_null(pc.index_in(b["terms"], value_set=asked), -1).to_numpy()
            hit = np.flatnonzero(number >= 0)
            total[number[hit]] += b["df"].to_numpy()[hit]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, INT), pa.array(total[some])], ["term", "n"])

    counts = index.select("terms", "df").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    with few_rows_a_batch(index.sparkSession, BLOCKS_AT_ONCE):
        return {terms[r["term"]]: r["n"] for r in counts.collect()}  # of the terms of QUERY_BYTES


def _pairs(asked: DataFrame) -> Pairs:
    """Pairs (block, query) on the driver: PAIRS at most."""
    table = asked.select("block", "query").toArrow()
    return Pairs(table["block"].to_numpy(), table["query"].to_numpy())


FORWARD = ("sizes", "ends", "codes", "tfs")


def _scored(index: DataFrame, asked: DataFrame, weights: Weights, best: int) -> DataFrame:
    """query, doc_id, score of each task's best documents of the asked pairs of a block and a query."""
    pairs = _pairs(asked)

    @trimmed
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found(best, np.zeros(weights.n_queries, np.int64))
        for b in _rows(batches):
            queries = pairs.of(b["block"])
            for query, doc, total in weights.scores(b["terms"], *(b[c].to_numpy() for c in FORWARD), queries) if len(queries) else ():
                found.add(query, b["ids"].take(pa.array(doc)), total)
        yield found.batch()

    return index.select("block", "terms", "ids", *FORWARD).mapInArrow(score, "query int, doc_id long, score long")


def _rest(index: DataFrame, weights: Weights, best: int, done: Pairs, least: np.ndarray) -> DataFrame:
    """query, doc_id, score of each task's best documents of all pairs that aren't done and may reach ``least``, or what the task itself has found."""

    @trimmed
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found(best, least)
        for b in _rows(batches):
            queries = np.flatnonzero(_open(b, weights, done, found.least))
            for query, doc, total in weights.scores(b["terms"], *(b[c].to_numpy() for c in FORWARD), queries) if len(queries) else ():
                found.add(query, b["ids"].take(pa.array(doc)), total)
        yield found.batch()

    return index.select("block", "terms", "most", "thin", "ids", *FORWARD).mapInArrow(score, "query int, doc_id long, score long")


def _best(rows: DataFrame, best: int) -> DataFrame:
    """The best rows of each query with their rank; Spark drops others before it shuffles."""
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= best)


def _search(index: DataFrame, queries: list[tuple[int, list[str]]], n_docs: int, n_terms: int, best: int) -> DataFrame | None:
    """query, rank, doc_id and score for one set of queries."""
    df = _frequencies(index, sorted({t for _, ts in queries for t in ts}))
    if not df:
        return None
    weights = Weights(queries, df, n_docs, n_terms)
    done, least, most = Pairs(*np.zeros((2, 0), np.int64)), np.zeros(len(queries), np.int64), FIRST_BLOCKS
    found = index.sparkSession.createDataFrame([], "query int, doc_id long, score long, rank int")
    merged = lambda rows: materialise(_best(found.drop("rank").unionByName(rows), best), "found", BLOCKS_AT_ONCE)
    w = Window.partitionBy("query").orderBy(F.col("bound").desc(), "block")
    while most * len(queries) <= PAIRS or most == FIRST_BLOCKS:
        ahead = _bounds(index, weights, most, done, least).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
        new = materialise(ahead.select("block", "query"), "asked", BLOCKS_AT_ONCE)
        if new.isEmpty():
            return found
        found = merged(_scored(index, new, weights, best))
        # A query's k-th best score, 0 while it has found fewer: blocks below it can't add to the result.
        for r in found.where(F.col("rank") == best).select("query", "score").collect():  # one row a query asked at once
            least[r["query"]] = r["score"]
        asked = _pairs(new)
        done = Pairs(np.concatenate([np.repeat(done.block, np.diff(done.at)), np.repeat(asked.block, np.diff(asked.at))]), np.concatenate([done.query, asked.query]))
        most *= 4
    return merged(_rest(index, weights, best, done, least))


def search(index: DataFrame, queries: DataFrame, item: str = "item_id", text: str = "text", best: int = BEST) -> DataFrame:
    """item, rank, doc_id and score of the best documents of each query; every row of ``queries`` is a query."""
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    sized = queries.select(F.col(item).alias("item"), F.col(text).cast("string").alias("text")).withColumn("bytes", F.octet_length(F.coalesce("text", F.lit(""))) + 1024)
    dealt = materialise(running(sized, ("item",), ("bytes",)).withColumn("chunk", F.floor(F.col("bytes_before") / QUERY_BYTES)), "queries")
    kind, out = sized.schema["item"].dataType.simpleString(), None
    for (chunk,) in dealt.select("chunk").distinct().orderBy("chunk").collect() if n_docs else ():
        rows = dealt.where(F.col("chunk") == chunk).orderBy("place").select("item", "text").collect()  # of QUERY_BYTES, but for a longer single text
        asked = [(i, sorted(set(words_of(pa.array([t], pa.string()))[0].to_pylist()))) for i, t in rows]
        found = _search(index, asked, n_docs, n_terms, best)
        if found is not None:
            items = index.sparkSession.createDataFrame([(q, i) for q, (i, _) in enumerate(asked)], f"query int, `{item}` {kind}")
            part = found.join(F.broadcast(items), "query").select(item, "rank", "doc_id", "score")
            out = part if out is None else out.unionByName(part)
    return out if out is not None else index.sparkSession.createDataFrame([], f"`{item}` {kind}, rank int, doc_id long, score long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the ten best documents of every benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(build(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


ORACLE = """
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark)),
d AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY 1),
a AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS l FROM d),
p AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
k AS (SELECT term, CAST(floor(1000 * ln((2 * a.nd + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, a GROUP BY term, a.nd),
s AS (SELECT q.item_id, p.doc_id, CAST(sum(k.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * d.n * a.nd) // a.l)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN k USING (term) JOIN d USING (doc_id), a GROUP BY 1, 2),
r AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
