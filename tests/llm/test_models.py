"""Language ID, language model, mixing, BPE and the pipeline: held-out quality, base figures by hand, exact round trips."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from calorix.llm import bpe, langid, mixing, pitman_yor, quality, registry, simhash
from calorix.llm.shared import drop_step, materialise
from tests.llm.fixtures import awkward, empty

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def print_of(text):
    return simhash.fingerprint(text.translate(LOWER).encode())


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def save(docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_languages_of_held_out_documents(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = langid.query(spark, SF).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(docs) and all(r["held_out"] == (crc(r["doc_id"], 4) == 2) for r in rows)
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_learning_ignores_held_out_labels_and_prediction_ignores_source(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wrong = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    a = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, langid.fit(docs)).collect()}
    b = {r["doc_id"]: r["lang_pred"] for r in langid.identify(wrong, langid.fit(wrong)).collect()}
    assert a == b


def test_language_edges(spark):
    docs = awkward(spark)
    rows = {r["doc_id"]: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["rejected"] for i in (0, 1, 2, 9, 10)) and rows[3]["lang_pred"] in ("en", "de")
    nothing = langid.fit(empty(spark))
    assert langid.identify(docs, nothing).where("lang_pred <> 'und'").count() == 0
    assert langid.keep_identified(empty(spark)).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert langid.identify(unlabelled, langid.fit(unlabelled)).count() == docs.count()


def test_character_models_are_distributions(spark):
    sample = spark.createDataFrame([("en", "the then than that"), ("de", "der die das dann")], "lang string, text string")
    models = langid.Models.learn(sample)
    letters = "abcdefghijklmnopqrstuvwxyz"
    first = models.word_scores(["t" + c for c in letters]) - 0
    assert first.shape == (26, 2) and (first < 0).all()
    # next characters after "th": all seen ones and the rest sum to less than one
    ends = models.word_scores(["th"])
    assert (np.exp(ends) < 1).all()


def kneser_ney(words, order):
    """P(next | up to order - 1 characters before) of a word list, by the textbook formula in plain dictionaries."""
    grams = Counter("\x02" * (order - 1) + w + "\x03" for w in words)
    counts = {order: Counter()}
    for w, n in grams.items():
        for i in range(len(w) - order + 1):
            counts[order][w[i : i + order]] += n
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount = {}
    for n, found in counts.items():
        once, twice = (sum(c == k for c in found.values()) for k in (1, 2))
        discount[n] = once / (once + 2 * twice) if once and twice else 0.5

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / 1000
        mine = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1]}
        total = sum(mine.values())
        if not total:
            return p(gram[1:])
        return max(mine.get(gram, 0) - discount[n], 0) / total + discount[n] * len(mine) / total * p(gram[1:])

    return p


def test_character_models_equal_the_textbook(spark):
    rng = random.Random(5)
    texts = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(60)] for lang, letters in (("en", "etaoin"), ("de", "enisrä"))}
    sample = spark.createDataFrame([(lang, " ".join(words)) for lang, words in texts.items()], "lang string, text string")
    models, asked = langid.Models.learn(sample), [*texts["en"][:10], *texts["de"][:10], "q", "eqä", "tea"]
    found = models.word_scores(asked)
    for i, lang in enumerate(models.langs):
        p = kneser_ney(texts[lang], langid.ORDER)
        for word, score in zip(asked, found[:, i]):
            padded = "\x02" * (langid.ORDER - 1) + word + "\x03"
            expected = sum(math.log(p(padded[k : k + langid.ORDER])) for k in range(len(word) + 1))
            assert score == pytest.approx(expected, rel=1e-4), (lang, word)


def test_noise_is_rejected_with_a_low_score(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    models = langid.fit(docs)
    noise = spark.createDataFrame([(i, t) for i, t in enumerate(["zzzzqqqq xxkj wvvq qqzx kkwj", "你好世界", "qwrtp sdfgh jklzx cvbnm " * 20])], "doc_id long, text string")
    assert all(r["rejected"] and r["score"] < 0.1 for r in langid.identify(noise, models).collect())
    good = langid.identify(docs.where("text is not null"), models)
    assert good.where("rejected").count() <= 2


def lm_by_hand(rows):
    split = [(i, WORDS.findall((t or "").translate(LOWER)) + [None], crc(i, 5) == 1) for i, t in rows]
    counts = Counter(w for _, ws, held in split if not held for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {i: (held, len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws, held in split}


def test_lm_base_and_quality(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pitman_yor, "BLOCK_BYTES", 200_000)  # many blocks
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = awkward(spark).select((F.col("doc_id") + 100_000).alias("doc_id"), "text")
    rows = {r["doc_id"]: r for r in pitman_yor.query(spark, save(docs.union(odd), tmp_path)).collect()}
    expected = lm_by_hand([(r["doc_id"], r["text"]) for r in docs.union(odd).collect()])
    assert len(rows) == len(expected)
    for i, (held, tokens, known, n, base) in expected.items():
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, tokens, known, n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    held = [r for i, r in rows.items() if r["held_out"] and i < 100_000]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def log_stirling(c, d):
    found = np.zeros(1)
    for n in range(2, c + 1):
        found = np.append(np.logaddexp(found + np.log(n - 1 - d * np.arange(1, n)), np.append(-np.inf, found[:-1])), found[-1])
    return found


@pytest.mark.parametrize("customers, discount, strength, base, others", [(10, 0.5, 1, 0.1, 0), (50, 0.7, 1, 0.05, 20), (400, 0.7, 1, 0.3, 5), (2000, 0.5, 10, 0.001, 5000), (3000, 0.6, 1, 0.5, 40)])
def test_gibbs_draws_follow_the_exact_posterior(customers, discount, strength, base, others):
    rng = np.random.default_rng(8)
    t = np.arange(1, customers + 1)
    law = log_stirling(customers, discount) + t * np.log(base) + np.cumsum(np.log(strength + discount * (others + np.arange(customers))))
    law = np.exp(law - law.max())
    mean = (law * t).sum() / law.sum()
    tables, seen = np.ones(5000), []
    for sweep in range(14):
        x = pitman_yor.draw_strength(others + tables, discount, strength, rng)
        tables = pitman_yor.draw_tables(np.full(5000, customers), x * base, discount, rng)
        if sweep > 5:
            seen.append(tables.mean())
    assert np.mean(seen) == pytest.approx(mean, rel=0.03)
    assert pitman_yor.mean_tables(np.full(5000, customers), x * base, discount).mean() == pytest.approx(mean, rel=0.03)


def test_lm_equals_a_model_in_plain_dictionaries(spark, monkeypatch):
    """Pair counts, restaurants and scores by hand; only the drawn variables are taken from the fit."""
    monkeypatch.setattr(pitman_yor, "BLOCK_BYTES", 400)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(20)]
    texts = [" ".join(rng.choices(words, range(20, 0, -1), k=rng.randint(0, 30))) for _ in range(80)]
    texts += [texts[3], "w1 unseen w2", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    teaches = lambda i: i % 4 != 1 and i < 81
    model = pitman_yor.fit(docs, (F.col("doc_id") % 4 != 1) & (F.col("doc_id") < 81))
    assert model.blocks.count() > 6
    split = {i: [b"", *(t or "").encode().split(), b""] for i, t in enumerate(texts)}
    pairs = Counter(p for i, w in split.items() if teaches(i) for p in zip(w, w[1:]))
    after = Counter()
    for (u, _), c in pairs.items():
        after[u] += c
    once, twice = (sum(c == k for c in pairs.values()) for k in (1, 2))
    d = model.discount
    assert d == pytest.approx(min(max(once / (once + 2 * twice), 0.1), 0.9))
    # The last sweep's drawn x and parent's predictions by word, as blocks were given them.
    drawn = {}
    for r in model.blocks.join(model.drawn_with, "block").collect():
        r = r.asDict()
        for w, x, logp in zip(r["words"], pitman_yor.joined_values(r, "x", "<f4"), pitman_yor.joined_values(r, "logp", "<f4")):
            drawn[bytes(w)] = (x, 10.0**logp)
    tables = {p: float(pitman_yor.mean_tables(np.array([c]), np.array([drawn[p[0]][0] * drawn[p[1]][1]]), d)[0]) for p, c in pairs.items()}
    t_of = Counter()
    for (u, _), t in tables.items():
        t_of[u] += t
    lexicon = {bytes(r["word"]): r for r in model.lexicon.collect()}
    parent = {w: 10 ** r["logp"] for w, r in lexicon.items()}
    assert all(lexicon[w]["c"] == c for w, c in after.items()) and all(lexicon[u]["t"] == pytest.approx(t_of[u], rel=1e-5) for u in after)
    unknown = 10**model.unknown
    assert sum(parent.values()) + unknown == pytest.approx(1, abs=1e-6)

    def p(u, w):
        return (pairs[u, w] - d * tables.get((u, w), 0) + (1 + d * t_of[u]) * parent.get(w, unknown)) / (1 + after[u])

    for u in [*after, b"unseen"]:
        assert sum(p(u, w) for w in parent) + p(u, b"?") == pytest.approx(1, abs=1e-5)
    found = {r["doc_id"]: r["score"] for r in pitman_yor.scored(model).collect()}
    assert len(found) == len(texts)
    for i, w in split.items():
        assert found[i] == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip(w, w[1:])), rel=1e-4, abs=1e-5)
    shuffled = " ".join(reversed(texts[3].split()))
    other = pitman_yor.fit(docs.union(spark.createDataFrame([(95, shuffled)], docs.schema)), F.col("doc_id") < 81)
    ordered = {r["doc_id"]: r["score"] for r in pitman_yor.scored(other).collect()}
    assert ordered[95] < ordered[3]


def test_messages_carry_keys_and_counts():
    rng = np.random.default_rng(2)
    keys = np.sort(rng.integers(0, 2**47, 5000, dtype=np.uint64))
    counts = rng.integers(0, 300, 5000)
    rows = pitman_yor.coded(7, keys, 47, 5, counts)
    back = np.concatenate([pitman_yor.golomb_decode(r[2], r[3], r[4], r[5]) + (np.uint64(r[1]) << np.uint64(42)) for r in rows])
    assert (back == keys).all() and (np.concatenate([pitman_yor.unpacked(r[6], "<u4") for r in rows]) == counts).all()


def test_spelling_predictions_sum_to_one():
    rng = np.random.default_rng(1)
    tree = pitman_yor.SpellingTree(np.array([0, 0, 5, 9]), np.array([97, 98, 97, 32]), np.array([50, 1, 3, 1000]))
    mean, tables = tree.sample(np.full(256, 1 / 256), rng)
    assert np.allclose(mean.sum(1), 1) and tables.sum() >= 3


def test_lm_edges(spark):
    nobody = pitman_yor.fit(empty(spark), F.lit(True))
    assert nobody.n == 0 and pitman_yor.scored(nobody).count() == 0
    untaught = pitman_yor.fit(awkward(spark), F.lit(False))
    assert untaught.n == 0 and pitman_yor.scored(untaught).where("score = 0 and base_score = 0 and n_known = 0").count() == awkward(spark).count()
    blank = spark.createDataFrame([(1, None), (2, ""), (None, " ")], "doc_id long, text string")
    model = pitman_yor.fit(blank, F.lit(True))
    rows = pitman_yor.scored(model).collect()
    assert model.n == 3 and model.types == 1 and len(rows) == 3 and len({r["score"] for r in rows}) == 1 and {r["n_tokens"] for r in rows} == {1}


def test_oracles_agree(spark, tmp_path):
    path = save(awkward(spark).union(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000", "text", "lang", "source", "n_chars", "'x'", "'y'", "'z'")), tmp_path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    for name in ("embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    for name, sql in registry.ORACLES.items():
        found, expected = registry.QUERIES[name](spark, path).toPandas(), con.sql(sql).df()
        columns = sorted(found.columns)
        assert columns == sorted(expected.columns)
        plain = lambda v: None if v is None or v != v or v is pd.NA else int(v) if isinstance(v, float) and v.is_integer() else v
        key = lambda df: sorted(repr([plain(v) for v in r]) for r in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None))  # noqa: B023, E731
        assert key(found) == key(expected), name


def test_mix_meets_targets_and_caps(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(1, 30)), rng.choice(["a", "a", "a", "a", "b", "c", None])) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.plan_mix(docs).toPandas()
    by = plan.assign(taken=plan["size"] * plan["n_copies"]).groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert (abs(by["taken"] / by["target"] - 1) < 0.05).all() and (by["target"] <= 3 * by["size"] + 1e-6).all()
    assert by["target"].sum() == pytest.approx(plan["size"].sum())
    assert plan["n_copies"].max() <= 3
    assert mixing.mix(docs).count() == plan["n_copies"].sum()
    assert mixing.mix(docs).columns == docs.columns


@pytest.mark.parametrize("ids", ["null in one source", "every second null", "one id", "equal rows"])
def test_mix_meets_targets_whatever_the_ids(spark, ids):
    rng = random.Random(5)
    rows = []
    for i in range(6000):
        source = f"s{i % 3}"
        text = "same words in all of them" if ids == "equal rows" and source == "s0" else " ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.randint(1, 19)))
        null = ids == "null in one source" and source == "s0" or ids == "every second null" and i % 2
        rows.append((None if null else 7 if ids == "one id" or ids == "equal rows" and source == "s0" else i, text, source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = lambda df: sorted(tuple(r) for r in mixing.plan_mix(df).groupBy("source").agg(F.sum(F.col("size") * F.col("n_copies")).alias("n"), F.first("target").alias("t")).collect())
    found = taken(docs.repartition(7))
    assert all(abs(n / t - 1) < 0.05 for _, n, t in found), found
    assert [r[:2] for r in taken(docs.repartition(3))] == [r[:2] for r in found], "reruns agree, however the rows are dealt"


def test_mix_edges(spark):
    assert mixing.mix(empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert mixing.plan_mix(blank).where("n_copies = 0 and target = 0").count() == 2
    clash = awkward(spark).withColumnsRenamed({"ids": "size", "kept": "target", "lang_pred": "row"})
    assert mixing.mix(clash).columns == clash.columns


def test_samples_are_drawn_by_row(spark, monkeypatch):
    """Null and repeated ids are drawn as others are; no sample is above its bound."""
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 60)
    monkeypatch.setattr(langid, "CALIBRATION_DOCS", 30)
    rows = [(None, f"ein wort {i}", "de") for i in range(300)] + [(8, f"a word {i}", "en") for i in range(300)] + [(i, f"un mot {i}", "fr") for i in range(300)] + [(9, "same row", "xx")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = Counter((r["lang"], r["part"]) for r in langid.samples(docs).collect())
    assert found == {("de", 0): 60, ("de", 1): 30, ("en", 0): 60, ("en", 1): 30, ("fr", 0): 60, ("fr", 1): 30, ("xx", 0): 1}
    monkeypatch.setattr(quality, "SAMPLE_DOCS", 50)
    docs = spark.createDataFrame([(5, f"text {i}") for i in range(400)] + [(100 + i, f"other {i}") for i in range(400)], "doc_id long, text string")
    ratings = spark.createDataFrame([(5, 1)] * 300 + [(100 + i, i % 2) for i in range(400)] + [(None, 1)], "doc_id long, grade int")
    sample = quality.rated_sample(docs, ratings).collect()
    assert Counter(r["grade"] for r in sample) == {0: 50, 1: 50} and {round(r["times"], 2) for r in sample} == {4.0, 4.02}
    assert sum(r["text"].startswith("text") for r in sample) <= 1


def test_bpe_equals_the_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    docs = awkward(spark).union(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000", "text", "lang", "source", "n_chars", "'x'", "'y'", "'z'"))
    more = ["İstanbul ΣΑΣ ﬁ ½ x² ٣ ８", "é ẛ̣ ͅ", "a b\u0085c d​e", "it's WE'LL 'Tis 'S ’s", "힣 한국어 ไทย हिन्दी 🇫🇷👩‍👩‍👧", "<|endoftext|><|startoftext|", "Ǆ ǅ ǆ ȷ ɐ", "\x00\x01\x7f"]
    docs = docs.union(spark.createDataFrame([(9000 + i, t, None, None, 0, "", "", "") for i, t in enumerate(more)], docs.schema))
    rows = bpe.encode_texts(docs, bpe.default_path()).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids, (r["text"] or "")[:80]
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_every_latin_character_encodes_like_the_library():
    own = bpe.encoder(bpe.default_path())
    for start in range(0, 0x2100, 64):
        text = " ".join(f"a{chr(c)}B{chr(c)}" for c in range(start, start + 64))
        assert [i for w in own.encode(text) for i in w] == own.library.encode(text, add_special_tokens=False).ids, hex(start)


def test_forced_cuts_exist_and_are_certain():
    own = bpe.encoder(bpe.default_path())
    rng = random.Random(3)
    text = "".join(rng.choice("abqxéжλ中ñ") for _ in range(3000))
    symbols = own.symbols("".join(own.bytes[b] for b in text.encode()), True)
    assert any(f"{a}\0{b}" not in own.adjacent for a, b in zip(symbols, symbols[1:]))
    assert [i for w in own.encode(text) for i in w] == own.library.encode(text, add_special_tokens=False).ids


def test_bpe_digests(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in bpe.query(spark, SF).limit(5).collect():
        text = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id") == r["doc_id"]).first()["text"]
        ids = library.encode(text, add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r["n_tokens"] == len(ids)
    assert bpe.token_digests(bpe.encode_texts(empty(spark), bpe.default_path())).count() == 0


def test_quality_of_held_out_ratings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rated = quality.graded_labels(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    model = quality.learn(docs, rated.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 0))
    assert (np.diff(model.thresholds) > 0).all()
    out = quality.grade(docs.select("doc_id", "text"), model).join(rated, "doc_id").toPandas()
    assert ((out["tail_prob"] >= 0) & (out["expected_grade"] <= 2)).all()
    held = out[out["doc_id"].map(lambda i: crc(i, 4) == 0)]
    good, bad = held[held["grade"] == 2], held[held["grade"] < 2]
    assert good["kept"].mean() > 0.9 and good["expected_grade"].mean() > bad["expected_grade"].mean() + 0.5


def test_quality_equals_a_plain_model(spark):
    """Scores from the weights by the textbook formula, and weights at an optimum of the penalised likelihood."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ratings = quality.graded_labels(spark.read.parquet(f"{SF}/labels.parquet"))
    model = quality.learn(docs, ratings)
    own = quality.Features()
    for r in quality.grade(docs.select("doc_id", "text"), model).limit(40).collect():
        score = sum(float(np.float32(model.weights[k])) for k in own.of_text(r["text"] or ""))
        tails = [1 - 1 / (1 + math.exp(-(t - score))) for t in model.thresholds]
        assert r["expected_grade"] == pytest.approx(sum(tails), rel=1e-4) and r["tail_prob"] == pytest.approx(tails[-1], rel=1e-4, abs=1e-6)
        assert r["kept"] == (r["tail_prob"] >= quality.KEEP_TAIL)
    grades = {r["doc_id"]: r["grade"] for r in ratings.collect() if r["grade"] is not None}
    rows = [(own.of_text(r["text"] or ""), grades[r["doc_id"]]) for r in docs.collect() if r["doc_id"] in grades]

    def loss(weights, thresholds):
        total = 0.0
        for slots, g in rows:
            s = weights[slots].sum()
            below = [0.0, *(1 / (1 + math.exp(-(t - s))) for t in thresholds), 1.0]
            total -= math.log(max(below[g + 1] - below[g], 1e-9))
        return total / len(rows) + quality.PENALTY * np.abs(weights).sum()

    best, rng = loss(model.weights, model.thresholds), np.random.default_rng(3)
    used = np.flatnonzero(model.weights)
    for _ in range(6):
        other = model.weights.copy()
        other[used] += rng.normal(size=len(used)) * 0.5
        assert loss(other, model.thresholds) > best - 1e-3
    assert loss(model.weights, model.thresholds + 1.0) > best - 1e-3 and loss(np.zeros_like(model.weights), model.thresholds) > best


def test_quality_edges(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([], "doc_id long, grade int")
    assert quality.grade(docs, quality.learn(docs, none)).where("kept and tail_prob is null").count() == docs.count()
    one = spark.createDataFrame([(3, 1), (4, 1), (None, 0), (5, None)], "doc_id long, grade int")
    assert quality.learn(docs, one) is None
    two = spark.createDataFrame([(3, 0), (4, 1), (5, 1), (6, 0), (6, 0)], "doc_id long, grade int")
    assert quality.grade(docs.drop("kept").withColumnRenamed("ids", "tail_prob"), quality.learn(docs, two)).count() == docs.count()
    assert quality.grade(empty(spark), quality.learn(empty(spark), two)).count() == 0


def test_pipeline_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [r["text"] for r in docs.where("length(text) > 2000").collect()]
    # Near copies within the radius: whole texts without their last words.
    near = [t.rsplit(" ", k)[0] for t in texts for k in (1, 2)]
    far = lambda a, b: (print_of(a) ^ print_of(b)).bit_count()
    near = [n for n, t in zip(near, [t for t in texts for _ in (1, 2)]) if 1 <= far(n, t) <= 2]
    assert near
    docs = docs.union(spark.createDataFrame([(5000 + i, t, "en", "src1", len(t)) for i, t in enumerate(near)], docs.schema))
    docs.write.parquet(f"{tmp_path}/in/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/in/documents.parquet")
    columns, ids = docs.columns, [{r["doc_id"] for r in docs.select("doc_id").collect()}]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        assert ids[-1] <= ids[-2]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert len(ids[2]) < len(ids[1]) and ids[3] <= ids[2] - set(range(5000, 5000 + len(near)))
    assert corpus_pipeline.run(spark, f"{tmp_path}/in").count() == docs.count()


def test_pipeline_on_awkward_and_empty_tables(spark, tmp_path):
    """Stage by stage against what each should keep, with null and repeated ids beside unlike texts."""
    docs = awkward(spark).select("doc_id", "text", "lang", "source", "n_chars")
    plain = " ".join(f"house{i} river" for i in range(60))
    more = [(None, plain.upper(), "en", "s0", 1), (None, plain, "en", "s0", 1), (7, plain + " end", "en", "s1", 1), (7, "quite another text of some words", "en", "s1", 1)]
    docs = docs.union(spark.createDataFrame(more, docs.schema))
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    key = lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in df.select("doc_id", "text").collect())
    identified = corpus_pipeline.language_id(spark, docs, "")
    judged = langid.identify(docs, langid.fit(docs))
    assert key(identified) == key(judged.where("not rejected"))
    exact = corpus_pipeline.exact_dedup(spark, docs, "").collect()
    best = {}
    for r in docs.collect():
        t = (r["text"] or "").translate(LOWER)
        rank = (r["doc_id"] is not None, r["doc_id"] or 0)
        best[t] = max(best.get(t, (False, 0)), rank)
    assert sorted(((r["text"] or "").translate(LOWER), (r["doc_id"] is not None, r["doc_id"] or 0)) for r in exact) == sorted(best.items())
    near = corpus_pipeline.near_dedup(spark, docs, "").collect()
    texts = [(r["text"] or "").translate(LOWER).split() for r in docs.collect()]
    shingles = {tuple(t): frozenset(tuple(t[i : i + 5]) for i in range(max(len(t) - 4, 1))) if t else frozenset() for t in texts}
    kept = {shingles[tuple((r["text"] or "").translate(LOWER).split())] for r in near}
    alike = lambda a, b: (a == b) if not a or not b else len(a & b) >= 0.8 * len(a | b)
    assert all(any(alike(s, k) for k in kept) for s in shingles.values()) and len(kept) == len(near)
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    plan = Counter()
    for r in mixing.plan_mix(docs).collect():
        plan[r["doc_id"], r["row"]["text"]] += r["n_copies"]
    assert Counter((r["doc_id"], r["text"]) for r in mixed.collect()) == +plan and sum(plan.values()) > 0
    encoded = corpus_pipeline.encode(spark, docs, "")
    assert encoded.count() == docs.count()
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() > 0
    empty(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_a_written_step_leaves_no_shuffle_files(spark, tmp_path):
    jvm = spark.sparkContext._jvm
    files = lambda: {f for d in jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs() for f in Path(d.getPath()).rglob("shuffle_*")}
    before = files()
    rows = spark.range(100_000).groupBy((F.col("id") % 5000).alias("block")).agg(F.sum("id").alias("s"))
    assert materialise(rows, "sums").count() == 5000
    assert pitman_yor.bucketed(rows, "sums").agg(F.sum("s")).first()[0] == sum(range(100_000))
    for _ in range(50):
        left = {f for f in files() - before if f.exists() and f.stat().st_size > 1000}
        if not left:
            break
        time.sleep(0.1)
    assert not left


def test_a_superseded_step_is_taken_off_alone(spark):
    kept, gone = materialise(spark.range(10), "kept"), materialise(spark.range(10), "gone")
    folder = lambda step: Path(step.inputFiles()[0].removeprefix("file://")).parent
    there, dropped = folder(kept), folder(gone)
    drop_step(gone)
    assert there.is_dir() and not dropped.exists() and kept.count() == 10
