"""Language identification by interpolated Kneser-Ney character models.

One model per language over the characters of words (padded at both ends),
counted with Spark from a bounded sample of labelled documents.  The models of
all languages are stored together: one sorted array of n-gram hashes per order,
with a row of discounted probabilities and back-off weights over languages.  A
document gets the language of the lowest cross-entropy per character.

A second, separate sample calibrates, on whole documents and on pieces of 1, 2,
4, ... words of them.  Per language and length (each power of two of its
characters) it gives the cross-entropy that only REJECT_SHARE of the genuine ones
exceed; as genuine texts of one length are few, the largest within SPAN powers of
two counts.  That limit acts as one more language, ``und``: a text for which it has
the lowest cross-entropy is rejected, and the score is the posterior among all of
them, with a temperature fitted to the pieces.

Fitting bounds: SAMPLE_DOCS documents a language (expected, drawn by hash) for
the counts and CALIBRATION_DOCS for the calibration, one piece of each length a
document; scoring reads all texts.

Defined results: null texts and texts without a letter are ``und`` with score 0,
rejected; ties go to the first language in order; without labelled documents
everything is ``und``; a null doc_id is not held out; repeated rows get equal
results; extra columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calorix.llm.shared import BROADCAST_ROWS, materialise, strings, trimmed

SAMPLE_DOCS = 1500
CALIBRATION_DOCS = 400
ORDER = 4
START, END = "\x02", "\x03"
LETTERS = re.compile(r"[^\W\d_]+")
#: Share of the genuine texts of a language and length that its limit may reject.
REJECT_SHARE = 0.001
#: Powers of two that lengths are told apart by, and how many of them on each side share a limit.
LENGTHS, SPAN = 32, 4
ROWS_AT_ONCE = 128
#: Words that a worker remembers; then it starts anew.
CACHE_WORDS = 50_000
HASH_BASE = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: F.Column) -> F.Column:
    """Whether a document is kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return LETTERS.findall(text.lower())


def samples(docs: DataFrame) -> DataFrame:
    """Labelled documents to learn from, with ``part``: 0 for counts, 1 for calibration.

    Of each language the first so many by a hash of (doc_id, text), so that rows with
    null or repeated ids are drawn as others are and no more than SAMPLE_DOCS and
    CALIBRATION_DOCS are; rows that repeat both are drawn once.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    labelled = labelled.select("doc_id", F.xxhash64("text").alias("digest"), "lang", "text")
    keys = labelled.groupBy("lang", "doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).drop("n")
    keys = materialise(keys.withColumn("draw", F.xxhash64("doc_id", "digest", F.lit("langid"))), "labelled")
    sizes = {r["lang"]: r["n"] for r in keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    if not sizes:
        return labelled.where("false").select("doc_id", "text", "lang", F.lit(0).alias("part"))
    size = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(n))])[F.col("lang")]
    # Where few documents are labelled, a fifth of them calibrates.
    count = F.least(F.lit(SAMPLE_DOCS), F.ceil(size * 0.8))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("draw", F.lit(1_000_000)), "draw", "doc_id"))
    # The hash is even, so that about twice as many as wanted are left to be ranked, whatever the language's size.
    least = F.pmod("draw", F.lit(1_000_000)) * size < 2_000_000 * (SAMPLE_DOCS + CALIBRATION_DOCS)
    first = keys.where(least).withColumn("place", place).where(F.col("place") <= SAMPLE_DOCS + CALIBRATION_DOCS)
    drawn = first.withColumn("part", F.when(F.col("place") <= count, 0).when(F.col("place") <= count + F.least(F.lit(CALIBRATION_DOCS), F.ceil(size * 0.2)), 1)).where("part is not null")
    drawn = materialise(drawn.select(F.col("lang").alias("__lang"), F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), "part"), "drawn")
    few = F.broadcast(drawn) if drawn.count() <= BROADCAST_ROWS else drawn
    met = labelled.join(few, (F.col("digest") == F.col("__digest")) & (F.col("lang") == F.col("__lang")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    return met.groupBy("lang", "doc_id", "digest", "part").agg(F.first("text").alias("text")).select("doc_id", "text", "lang", "part")


def word_counts(sample: DataFrame) -> DataFrame:
    """(lang, word, n), counted per partition before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[tuple[str, str]] = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), strings(batch.column(1))):
                found.update((lang, w) for w in words_of(text))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(found.values(), pa.int64())], ["lang", "word", "n"]
            )

    return sample.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_tables(words: DataFrame) -> DataFrame:
    """(n, lang, gram, alpha, gamma): of each gram its discounted share of its context, and as a context its back-off weight."""
    padded = F.concat(F.lit(START * (ORDER - 1)), "word", F.lit(END))
    places = F.sequence(F.lit(1), F.length("padded") - (ORDER - 1))
    grams = (
        words.select("lang", padded.alias("padded"), F.col("n").alias("times"))
        .select("lang", "times", F.explode(F.transform(places, lambda i: F.substring("padded", i, ORDER))).alias("gram"))
        .groupBy("lang", "gram")
        .agg(F.sum("times").alias("c"))
    )
    tables = []
    for n in range(ORDER, 0, -1):
        grams = materialise(grams, f"grams-{n}")
        doubles = grams.groupBy("lang").agg(F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2"))
        discount = doubles.select("lang", F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("n1") / (F.col("n1") + 2.0 * F.col("n2"))).otherwise(0.5).alias("d"))
        of = F.substring("gram", 1, n - 1) if n > 1 else F.lit("")
        contexts = grams.groupBy("lang", of.alias("context")).agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("types")).join(discount, "lang")
        shares = grams.withColumn("context", of).join(contexts, ["lang", "context"])
        tables.append(shares.select(F.lit(n).alias("n"), "lang", "gram", (F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total")).alias("alpha"), F.lit(None).cast("double").alias("gamma")))
        tables.append(contexts.select(F.lit(n - 1).alias("n"), "lang", F.col("context").alias("gram"), F.lit(None).cast("double").alias("alpha"), (F.col("d") * F.col("types") / F.col("total")).alias("gamma")))
        if n > 1:
            grams = grams.groupBy("lang", F.substring("gram", 2, n - 1).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.union(t)
    return rows.groupBy("n", "lang", "gram").agg(F.max("alpha").alias("alpha"), F.max("gamma").alias("gamma"))


def hash_grams(points: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n code points that end at each place (of the place n - 1 and later)."""
    found = np.full(max(len(points) - n + 1, 0), n, np.uint64)
    for i in range(n):
        found = found * HASH_BASE + points[i : len(points) - n + 1 + i].astype(np.uint64)
        found ^= found >> np.uint64(29)
    return found


class Models:
    """Kneser-Ney models of all languages in sorted hash arrays."""

    def __init__(self, langs: list[str], tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]], temperature: float = 1.0, limits: np.ndarray | None = None):
        self.langs, self.tables, self.temperature = langs, tables, temperature
        #: per language and power of two of the characters; without a calibration nothing is rejected
        self.limits = np.full((len(langs), LENGTHS), 1e9) if limits is None else limits
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(langs)), np.float32)

    @classmethod
    def learn(cls, sample: DataFrame) -> Models:
        """Models from (lang, text) rows; the tables are bounded by the sample."""
        rows = gram_tables(word_counts(sample)).toArrow()
        langs = sorted(set(rows["lang"].to_pylist()))
        if not langs:
            return cls([], [])
        n, lang = rows["n"].to_numpy(), np.searchsorted(langs, rows["lang"].to_pylist())
        grams, alpha, gamma = rows["gram"].to_pylist(), np.nan_to_num(rows["alpha"].to_numpy()), rows["gamma"].to_numpy()
        tables = []
        for order in range(ORDER + 1):
            mine = np.flatnonzero(n == order)
            points = np.array([[ord(c) for c in grams[i]] for i in mine], np.uint64).reshape(len(mine), order)
            hashes = np.full(len(mine), order, np.uint64)
            for i in range(order):
                hashes = hashes * HASH_BASE + points[:, i]
                hashes ^= hashes >> np.uint64(29)
            keys, where = np.unique(hashes, return_inverse=True)
            a, g = np.zeros((len(keys), len(langs)), np.float32), np.ones((len(keys), len(langs)), np.float32)
            a[where, lang[mine]] = alpha[mine]
            g[where, lang[mine]] = np.where(np.isnan(gamma[mine]), 1.0, gamma[mine])
            tables.append((keys, a, g))
        return cls(langs, tables)

    def lookup(self, order: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Discounted shares and back-off weights of grams; 0 and 1 for those not seen."""
        keys, alpha, gamma = self.tables[order]
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        there = (keys[at] == hashes)[:, None]
        return np.where(there, alpha[at], np.float32(0)), np.where(there, gamma[at], np.float32(1))

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Natural log probability of each word (with its end) under each language."""
        padded = "".join(START * (ORDER - 1) + w + END for w in words)
        points = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(w) + ORDER for w in words])
        # Every gram that ends at a place is kept at that place; grams over a word's start are never used.
        p = np.full((len(points), len(self.langs)), np.float32(1 / 1000))
        weight = self.tables[0][2][0]
        for order in range(1, ORDER + 1):
            alpha, gamma = self.lookup(order, hash_grams(points, order))
            p[order - 1 :] = alpha + weight * p[order - 1 :]
            weight = gamma[: len(points) - order]
        logs = np.log(np.maximum(p, 1e-12))
        ends = np.cumsum(sizes)
        used = np.ones(len(points), bool)
        starts = ends - sizes
        for i in range(ORDER - 1):
            used[starts + i] = False
        logs[~used] = 0
        return np.add.reduceat(logs, starts, axis=0)

    def evaluate(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character under each language and number of characters of every text."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.scores = {}, np.zeros((0, len(self.langs)), np.float32)
        lists = [words_of(t) for t in texts]
        new = sorted(set().union(*lists) - self.known.keys())
        if new:
            made = [self.word_scores(new[i : i + 5_000]).astype(np.float32) for i in range(0, len(new), 5_000)]
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.scores = np.concatenate([self.scores, *made])
        totals, chars = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for i, words in enumerate(lists):
            if words:
                totals[i] = self.scores[list(map(self.known.__getitem__, words))].sum(0, dtype=float)
                chars[i] = sum(map(len, words)) + len(words)
        return -totals / np.maximum(chars, 1)[:, None], chars

    def limit(self, best: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The cross-entropy above which texts of these languages and lengths are rejected."""
        place = np.clip(np.log2(np.maximum(chars, 1)) - 0.5, 0, LENGTHS - 1.001)
        low = place.astype(int)
        return self.limits[best, low] * (low + 1 - place) + self.limits[best, low + 1] * (place - low)

    def posterior(self, entropy: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Probabilities of the languages and, last, of none of them."""
        none = self.limit(entropy.argmin(1), chars)
        logits = -self.temperature * np.column_stack([entropy, none]) * np.sqrt(chars)[:, None]
        odds = np.exp(logits - logits.max(1, keepdims=True))
        return odds / odds.sum(1, keepdims=True)

    def calibrate(self, langs: np.ndarray, entropy: np.ndarray, chars: np.ndarray) -> None:
        """Fit limits and temperature to texts and pieces of known language."""
        if not len(langs):
            return
        length = np.log2(chars).astype(int)
        for i in range(len(self.langs)):
            own = langs == i
            there = np.unique(length[own])
            if len(there):
                found = np.interp(np.arange(LENGTHS), there, [np.quantile(entropy[own & (length == n), i], 1 - REJECT_SHARE) for n in there])
                self.limits[i] = [found[max(n - SPAN, 0) : n + SPAN + 1].max() for n in range(LENGTHS)]

        def loss(t: float) -> float:
            self.temperature = t
            return -np.log(np.maximum(self.posterior(entropy, chars)[np.arange(len(langs)), langs], 1e-9)).mean()

        self.temperature = min((2.0**k for k in np.arange(-3, 5.01, 0.5)), key=loss)


def pieces_of(text: str, seed: int) -> list[str]:
    """The words of a text, and one run of 1, 2, 4, ... of them for every number below the whole."""
    words = words_of(text)
    found = [" ".join(words)]
    for size in range(len(words).bit_length() - 1):
        at = (seed * 0x9E3779B1 >> 7) % (len(words) - 2**size + 1)
        found.append(" ".join(words[at : at + 2**size]))
    return found


def fit(docs: DataFrame) -> Models:
    """Learn and calibrate from the labelled documents that are not held out."""
    sample = materialise(samples(docs), "langid-sample")
    models = Models.learn(sample.where("part = 0"))
    if models.langs:
        spread = docs.sparkSession.sparkContext.broadcast((models.langs, models.tables))  # bounded by SAMPLE_DOCS

        def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Models(*spread.value)
            for batch in batches:
                pieces = [(lang, p) for lang, text in zip(batch.column(0).to_pylist(), strings(batch.column(1))) for p in pieces_of(text, len(text))]
                entropy, chars = own.evaluate([p[1] for p in pieces])
                columns = [pa.array([p[0] for p in pieces], pa.string()), pa.array(list(entropy), pa.list_(pa.float64())), pa.array(chars)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "entropy", "chars"])

        # Bounded by CALIBRATION_DOCS and the logarithm of their lengths.
        rows = sample.where("part = 1").select("lang", "text").mapInArrow(evaluate, "lang string, entropy array<double>, chars double").where("chars > 0").toArrow()
        known = [(models.langs.index(a), *x) for a, *x in zip(*(rows[k].to_pylist() for k in ("lang", "entropy", "chars"))) if a in models.langs]
        if known:
            models.calibrate(*(np.array([k[i] for k in known]) for i in range(3)))
    return models


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """docs with lang_pred, score and rejected."""
    spread = docs.sparkSession.sparkContext.broadcast((models.langs, models.tables, models.temperature, models.limits))  # bounded by SAMPLE_DOCS
    added = ("lang_pred", "score", "rejected")
    spare = [c for c in docs.columns if c not in added]

    @trimmed
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Models(*spread.value)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(start, ROWS_AT_ONCE)
                texts = strings(rows.column("text"))
                langs, scores, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
                if own.langs:
                    entropy, chars = own.evaluate(texts)
                    best = entropy.argmin(1)
                    odds = own.posterior(entropy, chars)
                    for i in np.flatnonzero(chars):
                        if any(map(str.isalpha, texts[i])):
                            langs[i], scores[i] = own.langs[best[i]], odds[i, best[i]]
                            rejected[i] = odds[i, best[i]] < odds[i, -1]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in spare), pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)], [*spare, *added])

    narrow = docs.select(*spare)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in narrow.schema)
    return narrow.mapInArrow(predict, f"{schema}lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is not rejected."""
    return identify(docs, fit(docs)).where("not rejected").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: predicted language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
