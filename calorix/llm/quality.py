"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w . x): all grades share one vector of
weights over hashed text features, and ordered thresholds cut the latent score.
Features are present or absent: words, their first five and last three
characters, their shape, and buckets of length and of the share of distinct
words.  Weights are fitted by proximal AdaGrad with an L1 penalty, so that most
of a long text's ordinary words weigh nothing.

Fitting bound: SAMPLE_DOCS rated documents a grade (expected, drawn by hash),
each weighed back to its grade's share.  Scoring reads all texts.

Defined results: null and empty texts have the length feature only; without
ratings the expected grade is null, the tail probability is null and everything
is kept; of several ratings of one document all count; texts of any length are read
whole; repeated rows get equal results; an empty table gives an empty result; extra
columns pass through, but those named like a result are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calorix.llm.shared import BROADCAST_ROWS, WORD, materialise, strings

BITS = 18
SAMPLE_DOCS = 2000
SCREEN = 4.0
ROUNDS, RATE, PENALTY = 300, 0.3, 1e-5
CACHE_WORDS = 100_000
KEEP_TAIL = 0.25


class Features:
    """Hashed features of texts; those of words are remembered."""

    def __init__(self):
        self.known: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def slot(name: str) -> int:
        return xxhash.xxh32_intdigest(name.encode("utf-8", "surrogatepass"), 7) >> (32 - BITS)

    def of_word(self, word: str) -> tuple[int, ...]:
        low = word.lower()
        shape = ("A" if len(word) > 1 and word.isupper() else "a") + ("9" if not word.isalpha() else "") + ("" if word[-1:].isalnum() else word[-2:])
        return tuple({self.slot(f"w:{low.strip('.,')}"), self.slot(f"p:{low[:5]}"), self.slot(f"s:{low[-3:]}"), self.slot(f"h:{shape}")})

    def of_text(self, text: str) -> np.ndarray:
        words = WORD.findall(text)
        distinct = set(words)
        slots = {self.slot(f"n:{int(math.log2(len(words) + 1))}"), self.slot(f"d:{int(10 * len(distinct) / max(len(words), 1))}")}
        for w in distinct:
            found = self.known.get(w)
            if found is None:
                if len(self.known) >= CACHE_WORDS:
                    self.known.clear()
                found = self.known[w] = self.of_word(w)
            slots.update(found)
        return np.fromiter(slots, np.int32, len(slots))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class OrdinalModel:
    """Weights and ordered thresholds over hashed features."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, flat: np.ndarray, ends: np.ndarray, grades: np.ndarray, times: np.ndarray) -> OrdinalModel:
        """Fit to rows whose features are flat[ends[i-1]:ends[i]], each counted ``times``."""
        n_grades = int(grades.max()) + 1
        row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        telling = cls.telling(flat, row, grades)[flat]
        flat, row = flat[telling], row[telling]
        weights, squares = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8)
        share = np.cumsum(np.bincount(grades, times, n_grades))[:-1] / times.sum()
        free = np.log(np.clip(share, 1e-4, 1 - 1e-4) / (1 - np.clip(share, 1e-4, 1 - 1e-4)))
        # The first threshold and the logs of the gaps are free, so thresholds stay in order.
        free = np.append(free[:1], np.log(np.maximum(np.diff(free), 1e-2)))
        free_squares, total = np.full(len(free), 1e-8), times.sum()
        for _ in range(ROUNDS):
            cuts = cls.cuts(free)
            score = np.bincount(row, weights[flat], len(ends))
            padded = np.concatenate([[-np.inf], cuts, [np.inf]])
            upper, lower = padded[grades + 1] - score, padded[grades] - score
            su = np.where(np.isinf(upper), 1.0, sigmoid(upper))
            sl = np.where(np.isinf(lower), 0.0, sigmoid(lower))
            p = np.maximum(su - sl, 1e-9)
            du, dl = su * (1 - su) / p, sl * (1 - sl) / p
            by_score = times * (du - dl) / total  # of the negative log likelihood
            slope = np.bincount(flat, by_score[row], 1 << BITS)
            squares += slope * slope
            step = RATE / np.sqrt(squares)
            weights -= step * slope
            weights = np.sign(weights) * np.maximum(np.abs(weights) - step * PENALTY, 0)
            by_cut = np.array([-(times * du / total)[grades == k].sum() + (times * dl / total)[grades == k + 1].sum() for k in range(n_grades - 1)])
            # A gap moves all thresholds above it.
            by_free = np.array([by_cut.sum(), *(by_cut[k:].sum() * np.exp(free[k]) for k in range(1, n_grades - 1))])
            free_squares += by_free * by_free
            free -= 0.1 * by_free / np.sqrt(free_squares)
        return cls(weights, cls.cuts(free))

    @staticmethod
    def telling(flat: np.ndarray, row: np.ndarray, grades: np.ndarray) -> np.ndarray:
        """Features whose rate differs between the grades above and below any threshold."""
        n, found = np.bincount(flat, minlength=1 << BITS), np.zeros(1 << BITS, bool)
        for k in range(int(grades.max())):
            above = (grades > k).astype(float)
            p = above.mean()
            seen = np.bincount(flat, above[row], 1 << BITS)
            found |= np.abs(seen - n * p) > SCREEN * np.sqrt(np.maximum(n * p * (1 - p), 1e-9))
        return found

    @staticmethod
    def cuts(free: np.ndarray) -> np.ndarray:
        return np.cumsum(np.append(free[:1], np.exp(free[1:])))

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for every threshold k, a row per score."""
        return 1 - sigmoid(self.thresholds[None] - scores[:, None])


def rated_sample(docs: DataFrame, ratings: DataFrame) -> DataFrame:
    """(text, grade, times) of at most SAMPLE_DOCS rated documents a grade; ``times`` is how many each stands for.

    Of each grade the first so many ids by their hash; an id that repeats is drawn
    once, and where several texts have it the one of the least hash is read.
    """
    rated = ratings.where("grade is not null and doc_id is not null").select("doc_id", F.col("grade").cast("int").alias("grade")).distinct()
    draw = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_000))
    place = F.row_number().over(Window.partitionBy("grade").orderBy(draw, "doc_id"))
    sizes = {r["grade"]: r["n"] for r in rated.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per grade
    if not sizes:
        return docs.select("text").where("false").selectExpr("text", "0 as grade", "1D as times")
    size = F.create_map(*[x for g, n in sizes.items() for x in (F.lit(g), F.lit(float(n)))])[F.col("grade")]
    # The hash is even, so that about twice as many as wanted are left to be ranked, whatever the grade's size.
    drawn = rated.where(draw * size < 2_000_000 * SAMPLE_DOCS).withColumn("place", place).where(F.col("place") <= SAMPLE_DOCS).select("doc_id", "grade", F.greatest(F.lit(1.0), size / SAMPLE_DOCS).alias("times"))
    drawn = materialise(drawn, "drawn")
    drawn = F.broadcast(drawn) if drawn.count() <= BROADCAST_ROWS else drawn
    met = docs.select("doc_id", "text").join(drawn, "doc_id")
    return met.groupBy("doc_id", "grade", "times").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "grade", "times")


def learn(docs: DataFrame, ratings: DataFrame) -> OrdinalModel | None:
    """A model of grades 0, 1, ... by (doc_id, grade) ratings; none if fewer than two grades are there."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Features()
        for batch in batches:
            slots = pa.array([own.of_text(t) for t in strings(batch.column(0))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([slots, batch.column(1), batch.column(2)], ["slots", "grade", "times"])

    rows = rated_sample(docs, ratings).select("text", "grade", "times").mapInArrow(extract, "slots array<int>, grade int, times double").toArrow()
    if not len(rows) or len(set(rows["grade"].to_pylist())) < 2:
        return None
    slots = rows["slots"].combine_chunks()
    flat = slots.flatten().to_numpy()
    ends = np.cumsum([len(x) for x in slots])
    return OrdinalModel.fit(flat, ends, rows["grade"].to_numpy(), rows["times"].to_numpy())


def grade(docs: DataFrame, model: OrdinalModel | None) -> DataFrame:
    """docs with expected_grade, tail_prob (of the highest grade) and kept."""
    added = ("expected_grade", "tail_prob", "kept")
    spare = [c for c in docs.columns if c not in added]
    if model is None:
        return docs.select(*spare, F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_prob"), F.lit(True).alias("kept"))
    spread = docs.sparkSession.sparkContext.broadcast(OrdinalModel(model.weights.astype(np.float32), model.thresholds))  # of fixed size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, m = Features(), spread.value
        for batch in batches:
            scores = np.array([m.weights[own.of_text(t)].sum(dtype=float) for t in strings(batch.column("text"))])
            tails = m.tails(scores)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in spare), pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= KEEP_TAIL)], [*spare, *added])

    narrow = docs.select(*spare)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in narrow.schema)
    return narrow.mapInArrow(score, f"{schema}expected_grade double, tail_prob double, kept boolean")


def graded_labels(labels: DataFrame) -> DataFrame:
    """Grades from the labels: 0 toxic, 1 of low quality, 2 good."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: expected grade, tail probability and selection of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return grade(docs, learn(docs, graded_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))))
