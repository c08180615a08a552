"""Importance resampling of documents towards a target's texts.

Features are runs of 1 to MOST_WORDS words, hashed to buckets by CRC-32.  Each
task puts its texts into a trie of words whose nodes hold the feature's count and
the CRC state of its bytes, so that a longer feature goes on from its parent's
state; when a trie is full, and at the end, its counts go to bucket totals, which
are merged over tasks.  The second pass walks the same paths with each bucket's gain (how much
more likely the target holds it) attached to the nodes.  A document's score is its mean gain plus
Gumbel noise hashed from its id, so that the highest scores are a draw without
replacement.

Defined results: a null text has no words; documents without features weigh 0;
those with too few words are never drawn; a null doc_id is hashed as ``null``
and ranks after others of its score; rows that repeat an id get the same noise and are
ranked apiece; empty tables give no rows, and an empty target gains by the corpus
alone; other columns, of any name, are kept.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calorix.llm.shared import materialise, trimmed
from calorix.llm.words import slices, words_of
from calorix.operators.prefix import running

BUCKETS, MOST_WORDS, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Nodes of a trie before its counts go to the buckets and it starts anew.
TRIE_NODES = 300_000
#: Scores are whole numbers; candidates of the draw are found by a histogram of steps of this width, of a few hundred at any size of the data.
SCORE_STEP = 256


class WordTrie:
    """A trie of words: for each node its CRC state, its count and, if given, the gain of its bucket."""

    def __init__(self, buckets: int, most_words: int, gains: np.ndarray | None = None):
        self.buckets, self.most_words, self.gains = buckets, most_words, gains
        self.totals = np.zeros(buckets, np.int64)
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        self.spelled: list[bytes] = []
        self.children: dict[int, int] = {}
        self.crc, self.count, self.gain = [0], np.zeros(1, np.int64), np.zeros(1, np.int64)

    def flush(self) -> None:
        """Counts of all nodes to their buckets."""
        np.add.at(self.totals, np.array(self.crc[1:], np.int64) % self.buckets, self.count[1:])
        self.clear()

    def _codes(self, words: pa.Array) -> np.ndarray:
        encoded = words.dictionary_encode()
        own = np.empty(len(encoded.dictionary), np.int64)
        for i, w in enumerate(encoded.dictionary.to_pylist()):
            code = self.words.get(w)
            if code is None:
                code = self.words[w] = len(self.spelled)
                self.spelled.append(w.encode())
            own[i] = code
        return own[encoded.indices.to_numpy()]

    def _child(self, key: int) -> int:
        node = self.children.get(key)
        if node is None:
            parent, word = key >> 32, self.spelled[key & 0xFFFFFFFF]
            node = self.children[key] = len(self.crc)
            self.crc.append(zlib.crc32(word if parent == 0 else b" " + word, self.crc[parent]))
        return node

    def _grown(self) -> None:
        more = len(self.crc) - len(self.count)
        if more:
            self.count = np.append(self.count, np.zeros(more, np.int64))
            if self.gains is not None:
                self.gain = np.append(self.gain, self.gains[np.array(self.crc[-more:], np.int64) % self.buckets])

    def walk(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length of run: the nodes that the texts' features reach, and the texts they are in."""
        if len(self.crc) > TRIE_NODES:
            self.flush()
        words, text = words_of(texts)
        codes, first = self._codes(words), np.arange(len(words))  # first words of the runs
        at = np.zeros(len(words), np.int64)
        for n in range(1, self.most_words + 1):
            if n > 1:
                whole = first + n - 1 < len(words)
                whole[whole] = text[first[whole] + n - 1] == text[first[whole]]
                first, at = first[whole], at[whole]
            keys, inverse = np.unique((at << 32) | codes[first + n - 1], return_inverse=True)
            nodes = np.array([self._child(k) for k in keys.tolist()], np.int64)
            self._grown()
            at = nodes[inverse]
            yield at, text[first]

    def add(self, texts: pa.Array) -> None:
        """Count the texts' features."""
        for nodes, _ in self.walk(texts):
            self.count += np.bincount(nodes, minlength=len(self.count))

    def weigh(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, features and floored mean gain of each text."""
        n, features, gains, words = len(texts), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), None
        for nodes, text in self.walk(texts):
            here = np.bincount(text, minlength=n)
            words = here if words is None else words
            features += here
            np.add.at(gains, text, self.gain[nodes])
        return words, features, np.where(features > 0, gains // np.maximum(features, 1), 0)


def bucket_totals(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, most_words: int = MOST_WORDS) -> np.ndarray:
    """Features of all texts by bucket: one trie a task, one row a bucket and task, one number a bucket on the driver."""

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = WordTrie(buckets, most_words)
        for part in slices(batches, text):
            trie.add(part.column(text))
        trie.flush()
        some = np.flatnonzero(trie.totals)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(trie.totals[some])], ["bucket", "n"])

    totals = np.zeros(buckets, np.int64)
    for row in docs.select(text).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        totals[row["bucket"]] = row["n"]
    return totals


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of the target's share to the corpus's) of each bucket."""
    s_all, t_all, n = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, floored, from the first 32 bits of SHA-256 of seed and id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(u))).cast("long")


def weighed(docs: DataFrame, gains: np.ndarray, text: str = "text", most_words: int = MOST_WORDS, keep_text: bool = True) -> DataFrame:
    """row (all columns, or all but the text), n_words, n_features and weight of every document."""
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if keep_text or c != text]).alias("row"), F.col(text).cast("string").alias("text"))

    @trimmed
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = WordTrie(len(gains), most_words, gains)
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("row"), *map(pa.array, trie.weigh(part.column("text")))], ["row", "n_words", "n_features", "weight"])

    return kept.mapInArrow(weigh, f"row {kept.schema['row'].dataType.simpleString()}, n_words long, n_features long, weight long")


def ranked(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS, most_words: int = MOST_WORDS, buckets: int = BUCKETS, seed: int = SEED, keep_text: bool = True) -> DataFrame:
    """row, n_words, n_features, weight, score and rank (null if not drawn) of every document."""
    gains = bucket_gains(bucket_totals(docs, text, buckets, most_words), bucket_totals(target, text, buckets, most_words))
    scored = weighed(docs, gains, text, most_words, keep_text).withColumn("id", F.col(f"row.`{doc_id}`")).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    scored = materialise(scored, "scored")
    able = F.col("n_words") >= least_words
    steps = scored.where(able).groupBy(F.floor(F.col("score") / SCORE_STEP).alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    most, ahead, least = sum(r["n"] for r in steps) * percent // 100, 0, None
    for r in sorted(steps, key=lambda r: -r["step"]):
        if ahead < most:
            least, ahead = r["step"] * SCORE_STEP, ahead + r["n"]
    near = able & (F.col("score") >= least) if least is not None else F.lit(False)
    drawn = running(scored.where(near), (("score", False), "id"))
    rank = F.when(F.col("place") < most, F.col("place") + 1).alias("rank")
    return drawn.select(*scored.columns, rank).unionByName(scored.where(~near).withColumn("rank", F.lit(None).cast("long"))).drop("id")


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The documents drawn towards the target, with their own columns."""
    return ranked(docs, target, **options).where("rank is not null").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: weight, score and rank of every document, towards the benchmark's texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return ranked(docs, target, keep_text=False).select("row.doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 of each distinct word by folding its bytes over the table of the reversed polynomial.
ORACLE = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
c AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word FROM w) GROUP BY 1, 2),
k AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, j: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS t),
h AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
  lambda a, v: xor(a // 256, k.t[xor(a % 256, v) + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM (SELECT DISTINCT word FROM (SELECT word FROM c UNION ALL SELECT word FROM b)), k),
s AS (SELECT bucket, sum(n) AS s FROM c JOIN h USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM b JOIN h USING (word) GROUP BY 1),
a AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS s, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS t),
g AS (SELECT h.word, CAST(floor(1000 * ln((coalesce(t.t, 0)::DOUBLE + 1) * (a.s + 10000) / ((coalesce(s.s, 0)::DOUBLE + 1) * (a.t + 10000)))) AS BIGINT) AS gain
  FROM h LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), a),
f AS (SELECT doc_id, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS gain FROM c JOIN g USING (word) GROUP BY 1),
d AS (SELECT w.doc_id, len(w.words)::BIGINT AS n_features, CASE WHEN f.n IS NULL THEN 0 ELSE (f.gain - (((f.gain % f.n) + f.n) % f.n)) // f.n END::BIGINT AS weight,
  CAST('0x' || substr(sha256('2024:' || CAST(w.doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN f USING (doc_id)),
r AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS p FROM r WHERE n_features >= 20)
SELECT r.doc_id, n_features, weight, score, CASE WHEN p <= (SELECT count(*) * 10 // 100 FROM o) THEN p END AS rank FROM r LEFT JOIN o USING (doc_id)
"""
