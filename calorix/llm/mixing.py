"""Mixing sources to target weights with DataFrame functions only.

Tokens (words) are summed per source; targets are a water filling of all tokens
by the sources' weights under a cap of MAX_REPEAT times what a source has; a
source's repetition rate is target / size; every document is emitted floor(rate)
times, plus once more where a number in [0, 1) hashed from seed, doc_id, text and
the row's number among rows that repeat them falls under the fraction.

Defined results: a null text has no words; the null source is a source of its
own, last in order; rows with null or repeated ids are drawn apiece, so that
sources come near their targets whatever their ids; of rows that repeat id and
text it is the same number of rows in every run that gets the extra copy; sources
without words get target 0 and no copies; an empty table gives an empty mix; extra
columns pass through ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calorix.llm.shared import BROADCAST_ROWS, materialise

#: Weights by rank of the source, repeating.
WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
SEED = "mix-1"


def word_count(text):
    """Number of runs of other characters than space and 0x09-0x0D; null: 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size and target from (source, size) rows: one small row per source after a pre-aggregation."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    ranked = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(MAX_REPEAT))
    # Sources fill up in the order of cap / weight; `level` is the tokens per weight if all sources before this one are full.
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    filling = order.rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(filling), F.lit(0.0))
    levels = (
        ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("k", F.row_number().over(order))
        .withColumn("level", (F.sum("source_size").over(every) - before("cap")) / (F.sum("weight").over(every) - before("weight")))
        .withColumn("final", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("k", "level"))).over(every)["level"])
    )
    return levels.select("source", "source_size", F.least("cap", F.coalesce("final", F.lit(0.0)) * F.col("weight")).alias("target"))


def hashed_uniform(doc_id: Column, digest: Column, number: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of MD5 of seed, id, MD5 of the text and the row's number."""
    key = F.concat_ws(":", F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("null")), digest, number.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / float(2**48)


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``number`` from 1 among those with the same doc_id, digest and source.

    Only rows that repeat these (if any) are moved: they are numbered within the task
    that reads them, after the rows of the tasks before it, so that a group of any size
    is spread over tasks.
    """
    key = ("doc_id", "digest", "source")
    named = [F.col(c).alias(f"__{c}") for c in key]
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("digest") == F.col("__digest")) & F.col("source").eqNullSafe(F.col("__source"))
    repeats = materialise(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*named), "repeats")
    n = repeats.count()
    if not n:
        return rows.withColumn("number", F.lit(1).cast("long"))
    few = F.broadcast(repeats) if n <= BROADCAST_ROWS else repeats
    once = rows.join(few, same, "left_anti").withColumn("number", F.lit(1).cast("long"))
    again = materialise(rows.join(few, same, "left_semi").withColumn("__task", F.spark_partition_id()), "repeated")
    tasks = again.groupBy(*key, "__task").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a task
    offsets = tasks.select(*named, F.col("__task").alias("__of"), before.alias("__before"))
    own = F.row_number().over(Window.partitionBy(*key, "__task").orderBy("__task"))
    placed = again.withColumn("__own", own).join(offsets, same & (F.col("__task") == F.col("__of")))
    return once.unionByName(placed.withColumn("number", F.col("__own") + F.col("__before")).select(*once.columns))


def plan_mix(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), doc_id, size, source_size, target and n_copies."""
    sized = docs.select(F.struct("*").alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("digest"))
    shares = materialise(targets(sized.select("source", "size")), "targets").withColumnRenamed("source", "__of")
    # One row per source: broadcast if they are few, so that texts aren't dealt out by a source that may hold most of them.
    shares = F.broadcast(shares) if shares.count() <= BROADCAST_ROWS else shares
    planned = numbered(sized).join(shares, F.col("source").eqNullSafe(F.col("__of"))).drop("__of")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MAX_REPEAT)))).otherwise(0.0)
    whole = F.floor(rate)
    extra = (hashed_uniform(F.col("doc_id"), F.col("digest"), F.col("number")) < rate - whole).cast("long")
    return planned.withColumn("n_copies", (whole + extra).cast("long"))


def mix(docs: DataFrame) -> DataFrame:
    """Every document as often as the mix takes it, with the columns of ``docs``."""
    copies = plan_mix(docs).where("n_copies > 0")
    return copies.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: what the mix takes of each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return plan_mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


ORACLE = """
WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS digest, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS s FROM d GROUP BY source),
w AS (SELECT source, s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s),
o AS (SELECT *, 3e0 * s / w AS ratio, row_number() OVER (ORDER BY 3e0 * s / w, source NULLS LAST) AS k FROM w),
p AS (SELECT *, (sum(s) OVER () - coalesce(sum(3e0 * s) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
  / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM o),
l AS (SELECT arg_min(level, k) AS level FROM p WHERE ratio >= level),
t AS (SELECT source, s, least(3e0 * s, coalesce(l.level, 0e0) * w) AS target FROM w LEFT JOIN l ON true),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, digest, source) AS k FROM d),
r AS (SELECT d.doc_id, d.size, CAST(t.s AS BIGINT) AS source_size, t.target, CASE WHEN t.s > 0 THEN least(t.target / t.s, 3e0) ELSE 0e0 END AS rate,
  CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || d.digest || ':' || d.k), 1, 12)) AS BIGINT) / 281474976710656e0 AS u
  FROM n AS d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
