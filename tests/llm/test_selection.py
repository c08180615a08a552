"""Importance resampling, packing and lexical search against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from calorix.llm import importance, lexical, packing, tokens
from calorix.llm.bpe import default_path
from tests.llm.fixtures import awkward, empty

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def plain_ranks(docs, target, most, buckets, percent, least):
    """(doc_id, text) to sorted (doc_id, n_features, weight, score, rank)."""
    features = lambda t: [" ".join(w[i : i + n]) for w in [words(t)] for n in range(1, most + 1) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in docs for f in features(x)), Counter(bucket(f) for x in target for f in features(x))
    n_s, n_t, rows = sum(s.values()), sum(t.values()), []
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets))))
    for i, x in docs:
        f = features(x)
        weight = sum(gain(bucket(g)) for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = Counter()
    for p, r in enumerate(able[: len(able) * percent // 100]):
        rank[r] = p + 1
    return sorted(((*r[:4], rank.get(r)) for r in rows), key=repr)


@pytest.mark.parametrize("most, nodes", [(1, 300_000), (3, 50)])
def test_importance(spark, monkeypatch, most, nodes):
    monkeypatch.setattr(importance, "TRIE_NODES", nodes)
    docs = awkward(spark)
    target = spark.createDataFrame([("the Token of 1234 ümlaut",), (None,), ("ab AB it's",)], "text string")
    found = importance.ranked(docs, target, most_words=most, buckets=97, percent=40, least_words=3)
    assert found.select("row.*").columns == docs.columns
    got = sorted((tuple(r) for r in found.select("row.doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)
    assert got == plain_ranks([(r["doc_id"], r["text"]) for r in docs.collect()], [r[0] for r in target.collect()], most, 97, 40, 3)
    assert importance.resample(docs, target, percent=40, least_words=3).columns == docs.columns


def test_importance_repeats_and_empty(spark):
    text = "a b c d e f g h i j k l m n o p q r s t u"
    docs = spark.createDataFrame([(None, text)] * 150 + [(7, text)] * 50 + [(i, f"{text} x{i}") for i in range(100)], "doc_id long, text string")
    target = spark.createDataFrame([(text,)], "text string")
    rows = importance.ranked(docs, target).select("row.doc_id", "score", "rank").collect()
    drawn = sorted((r for r in rows if r["rank"]), key=lambda r: r["rank"])
    assert len(rows) == 300 and [r["rank"] for r in drawn] == list(range(1, 31))
    assert [r["score"] for r in drawn] == sorted((r["score"] for r in rows), reverse=True)[:30]
    assert importance.ranked(empty(spark), target).collect() == []
    none = importance.ranked(docs, target.where("text is null")).where("rank is not null").count()
    assert none == 30


def test_bulk_encoder_equals_library(spark):
    encoder, library = tokens.BulkEncoder(default_path()), Tokenizer.from_file(default_path())
    texts = [r["text"] or "" for r in awkward(spark).collect()]
    texts += ["'", "''", "'s", "''s", "!'s", "a's", "'tis", "'s's", "'re're", "'ll'", "we'd've", "'r", "'l", "x'", "12'3", "½²a'd", "don't' stop", "'S 'RE", "É'T", "a\n'll\n", "' s", "\x85\xa0", "-'-'m"]
    for size in (1, 7, len(texts)):
        got = [ids.tolist() for a in range(0, len(texts), size) for ids in encoder.encode(texts[a : a + size])]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder.encode([]) == []


@pytest.mark.parametrize("capacity, slack", [(2048, 1 / 32), (64, 1 / 32), (8, 0.5), (1, 0.0)])
def test_piece_lengths(capacity, slack):
    for n in range(1, 3 * capacity + 2):
        pieces = packing.piece_lengths(n, capacity, slack)
        assert sum(a for a, _ in pieces) == n
        for a, k in pieces:
            assert 0 < a and a * k <= capacity and k == capacity // a


@pytest.mark.parametrize("capacity", [2048, 16])
def test_packing(spark, capacity):
    docs = awkward(spark)
    library = Tokenizer.from_file(default_path())
    rows = packing.pack(docs.repartition(3), default_path(), capacity=capacity).select("*", "row.*").drop("row").collect()
    own = {r["doc_id"]: np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1], np.int32) for r in docs.collect()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(own)
    for i, ids in own.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and bytes(r["ids"]) == ids[at : at + r["length"]].tobytes()
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding <= 0.05 * sum(map(len, own.values()))
    whole = packing.sequences(packing.pack(docs, default_path(), capacity=capacity), capacity).collect()
    assert all(len(r["ids"]) == 4 * (r["length"] if r["length"] & (r["length"] - 1) == 0 else capacity) for r in whole)
    assert packing.pack(empty(spark), default_path()).collect() == []


def plain_search(docs, items, best=10):
    docs = [(i, Counter(words(t))) for i, t in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, length = len(docs), sum(d[2] for d in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, size in docs:
            m = 10 + 90 * size * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(words(text)) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:best])]
    return out


@pytest.mark.parametrize("block_bytes, query_bytes", [(1 << 18, 1 << 22), (300, 2500)])
def test_search(spark, monkeypatch, block_bytes, query_bytes):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(lexical, "QUERY_BYTES", query_bytes)
    monkeypatch.setattr(lexical, "FIRST_BLOCKS", 1)
    docs = awkward(spark).unionByName(awkward(spark, 5).withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id"))))
    items = [(1, "the ümlaut TOKEN of the"), (2, None), (3, "nowhere"), (4, "a b one 1234 ab x9 中文字"), (None, "password"), (5, "deadbeefdeadbeefdeadbeefdeadbeef0 it")]
    found = lexical.search(lexical.build(docs.repartition(2)), spark.createDataFrame(items, "item_id long, text string"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == sorted(plain_search(rows, items), key=repr)


def test_search_scores_few_blocks(spark, monkeypatch):
    """Blocks whose bound is below the tenth best score are not scored."""
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 2000)
    asked = []
    scored = lexical._scored
    monkeypatch.setattr(lexical, "_scored", lambda index, new, *a: asked.append(new.count()) or scored(index, new, *a))
    rows = [(i, f"common word{i % 7} " * 20 + ("needle pin " * (1 + i % 3) if i % 90 == 0 else "")) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = lexical.build(docs)
    found = lexical.search(index, spark.createDataFrame([(1, "needle pin common")], "item_id long, text string"))
    assert sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect())) == sorted(plain_search(rows, [(1, "needle pin common")]))
    assert sum(asked) < index.count() / 2
    assert lexical.search(lexical.build(empty(spark)), spark.createDataFrame([(1, "a")], "item_id long, text string")).collect() == []


@pytest.mark.parametrize("pairs", [1 << 17, 1])
def test_tasks_hold_few_blocks(spark, monkeypatch, pairs):
    """Blocks are written, read and sent to Python some at a time and are not dealt again, however many pairs are asked."""
    for name, value in (("BLOCK_BYTES", 1000), ("BLOCKS_AT_ONCE", 4), ("PAIRS", pairs)):
        monkeypatch.setattr(lexical, name, value, raising=False)
    rows = [(i if i % 50 else None, f"common word{i % 7} " * 10 + "needle pin " * (i % 5)) for i in range(600)]
    index = lexical.build(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    assert max(g.row_group(i).num_rows for g in groups for i in range(g.num_row_groups)) <= 4 < index.count()
    rows_of, plans = lexical._rows, []
    monkeypatch.setattr(lexical, "_rows", lambda batches: rows_of(checked(batches)))

    def checked(batches):
        for batch in batches:
            if batch.num_rows > 4:
                raise ValueError(f"{batch.num_rows} blocks at once")
            yield batch

    for name in ("_scored", "_rest"):
        monkeypatch.setattr(lexical, name, lambda *a, of=getattr(lexical, name): plans.append(of(*a)) or plans[-1])
    items = [(1, "needle pin common"), (2, "word3 pin"), (3, "common")]
    found = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == sorted(plain_search(rows, items), key=repr)
    assert len(plans) > 1 and not any(word in p._jdf.queryExecution().executedPlan().toString() for p in plans for word in ("Exchange", "Join"))


def test_occurrences_are_scored_some_at_a_time(monkeypatch):
    """Parts of whole documents give the scores that all of a block's occurrences give at once."""
    rng = np.random.default_rng(3)
    docs = [sorted(set(rng.integers(0, 30, 12).tolist())) for _ in range(40)]
    codes, tfs = np.concatenate(docs), rng.integers(1, 5, sum(map(len, docs)))
    sizes, ends, terms = np.array([3 * len(d) for d in docs]), np.cumsum([len(d) for d in docs]), [f"t{i}" for i in range(30)]
    weights = lexical.Weights([(q, terms[q % 7 : q % 7 + 9]) for q in range(20)], {t: 5 + i for i, t in enumerate(terms)}, 40, int(sizes.sum()))
    parts = lambda: list(weights.scores(pa.array(terms), sizes, ends, codes, tfs, np.arange(0, 20, 2)))
    (whole,) = parts()
    monkeypatch.setattr(lexical, "ROOM", 50, raising=False)
    some = parts()
    assert len(some) > 10 and max(len(q) for q, _, _ in some) < len(whole[0]) / 5
    assert sorted(zip(*map(np.concatenate, zip(*some)))) == sorted(zip(*whole)) and set(whole[0]) <= set(range(0, 20, 2))
