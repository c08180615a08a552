"""Exact, near and vector dedup against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from calorix.llm import cover, golomb_dedup, simhash
from calorix.llm.components import components
from calorix.llm.shared import materialise, text_digest
from tests.llm.fixtures import awkward, empty

DOCS = "/root/testdata/sf0.001/documents.parquet"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def classes(n, links):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=200), st.integers(1, 63))
def test_golomb_round_trip(values, k):
    values = np.unique(np.array(values, np.uint64))
    k = max(k, max(1, int(2**64 / len(values)).bit_length() - 6))  # unary parts stay short
    k = min(k, 63)
    assert (golomb_dedup.golomb_decode(len(values), k, *golomb_dedup.golomb_encode(values, k)) == values).all()


def exact_by_hand(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    return {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


def test_exact_groups_equal_brute_force(spark):
    for docs in (awkward(spark), spark.read.parquet(DOCS)):
        docs = docs.repartition(5)
        expected = exact_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()])
        found = {r["doc_id"]: tuple(r)[1:] for r in golomb_dedup.exact_groups(docs).collect()}
        assert found == expected
        assert {r["doc_id"] for r in golomb_dedup.drop_exact(docs).collect()} == {i for i, v in expected.items() if v[2]}


def test_exact_dedup_edges(spark):
    assert golomb_dedup.exact_groups(empty(spark)).count() == 0
    assert golomb_dedup.drop_exact(empty(spark)).count() == 0
    rows = spark.createDataFrame([(None, "same"), (None, "Same"), (7, "x"), (7, "x")], "doc_id long, text string")
    assert golomb_dedup.exact_groups(rows).where("kept").count() == 4
    many = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('t', id)) as text").repartition(7)
    assert golomb_dedup.exact_groups(many).where("kept").count() == 2001


def print_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_groups_equal_brute_force(spark):
    plain = spark.read.parquet(DOCS)
    for docs in (awkward(spark), plain):
        rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
        prints = [print_by_hand(t) for _, t in rows]
        links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
        label = classes(len(rows), links)
        found = {r["doc_id"]: r for r in simhash.near_groups(docs).collect()}
        for (i, _), p, c in zip(rows, prints, label):
            assert found[i]["print"] % 2**64 == p and found[i]["component_id"] == rows[c][0]
        assert {r["doc_id"] for r in simhash.drop_near(docs).collect()} == {rows[c][0] for c in label}


def test_chains_of_near_prints_join(spark):
    rng = np.random.default_rng(3)
    prints = [int(x) for x in rng.integers(-(2**63), 2**63, 40)]
    for p in prints[:10]:
        for _ in range(6):
            p ^= (1 << int(rng.integers(63))) ^ (1 << int(rng.integers(63)))
            prints.append(p)
    prints = sorted(set(prints))
    links = [(i, j) for i in range(len(prints)) for j in range(i) if ((prints[i] ^ prints[j]) % 2**64).bit_count() <= 2]
    label = classes(len(prints), links)
    table = spark.createDataFrame([(p,) for p in prints], "print long")
    found = {r["node"]: r["component"] for r in components(simhash.linked(table)).collect()}
    assert all(found.get(p, p) == prints[c] for p, c in zip(prints, label))


def test_simhash_edges(spark):
    assert simhash.near_groups(empty(spark)).count() == 0
    assert simhash.drop_near(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        simhash.half_ball(3)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(200, 200)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(found[i] == 0 for i in range(61)) and all(found[i] == 100 for i in range(100, 160)) and found[200] == 200


def vectors_by_hand(rows, threshold=0.9):
    ok = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [(a, b) for a in range(len(ok)) for b in range(a) if len(ok[a][1]) == len(ok[b][1]) and ok[a][1] @ ok[b][1] / np.sqrt((ok[a][1] @ ok[a][1]) * (ok[b][1] @ ok[b][1])) >= threshold]
    label, n = classes(len(ok), links), [0] * len(ok)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    out = {i: (0, i, True) for i, _ in rows}
    out |= {ok[k][0]: (n[k], ok[label[k]][0], label[k] == k) for k in range(len(ok))}
    return out


@pytest.mark.parametrize("block", [40, 4096])
def test_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(cover, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(12):
        centre = rng.normal(size=6)
        rows += [(centre + rng.normal(size=6) * s).tolist() for s in rng.uniform(0, 0.5, 12)]
    rows += [rng.normal(size=6).tolist() for _ in range(40)] + [rows[0]] * 5 + [[3 * x for x in rows[1]]]
    rows += [None, [], [0.0] * 6, [float("nan")] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("inf")] + [0.0] * 5, [1.0, 2.0], [1.0, 2.0, 0.1], [1.0, 2.1], [1e200] * 6, [1e-200] * 6]
    table = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    big = len(rows) - 2
    expected = vectors_by_hand(list(enumerate(rows[:big])))  # the hand-made cosine overflows beyond
    found = {r["vec_id"]: tuple(r)[1:] for r in cover.near_vectors(table).collect()}
    assert len(found) == len(rows)
    assert found[big][1] == found[big + 1][1]
    plain = {r["vec_id"]: tuple(r)[1:] for r in cover.near_vectors(table.where(f"vec_id < {big}")).collect()}
    assert plain == expected


def test_dense_ball_is_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(cover, "BLOCK", 100)
    monkeypatch.setattr(cover, "PAIRS_AT_ONCE", 512)
    rng = np.random.default_rng(6)
    centre = rng.normal(size=8)
    rows = [(i, (centre + rng.normal(size=8) * 0.01).tolist()) for i in range(300)]
    found = cover.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all(r["n_links"] == 299 and r["component_id"] == 0 for r in found)


def test_vector_edges(spark):
    schema = "vec_id long, embedding array<float>, label string"
    assert cover.near_vectors(spark.createDataFrame([], schema)).count() == 0
    same = cover.near_vectors(spark.createDataFrame([(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (None, [1.0, 0.0], "b")], schema)).collect()
    assert sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in same) == [(-1, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True)]


def test_repeated_and_missing_vec_ids_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cover, "BLOCK", 16)
    rng = np.random.default_rng(7)
    base = [rng.normal(size=5) for _ in range(9)]
    rows = [(int(rng.integers(0, 30)) if rng.random() < 0.8 else None, (base[rng.integers(0, 9)] + rng.normal(size=5) * 0.12).tolist()) for _ in range(120)]
    rows += rows[:10] + [(77, base[0].tolist()), (77, (-base[0]).tolist()), (None, (100 * base[0]).tolist()), (None, None)]
    valid = [k for k, (_, v) in enumerate(rows) if v]
    unit = np.array([np.array(rows[k][1]) / np.linalg.norm(rows[k][1]) for k in valid])
    near = unit @ unit.T >= 0.9
    label = classes(len(valid), [(a, b) for a in range(len(valid)) for b in range(a) if near[a, b]])
    expected = [(None, 0, None, False)] * (len(rows) - len(valid))
    for a, k in enumerate(valid):
        ids = [rows[valid[b]][0] for b in range(len(valid)) if label[b] == label[a] and rows[valid[b]][0] is not None]
        least = min(ids, default=None)
        expected.append((rows[k][0], int(near[a].sum()) - 1, least, rows[k][0] is not None and rows[k][0] == least))
    found = cover.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()
    assert sorted(map(repr, (tuple(r) for r in found))) == sorted(map(repr, expected))


def test_cells_halve_and_blocks_are_bounded():
    rng = np.random.default_rng(9)
    points = cover.unit(np.concatenate([rng.normal(size=(600, 8)), rng.normal(size=8) + rng.normal(size=(900, 8)) * 0.2]))
    chosen = cover.centres_of(points, 15_000, 500)
    near = cover.distances(points, points[chosen]).argmin(1)
    assert len(set(chosen)) == len(chosen) and np.bincount(near).max() * 10 <= 1000
    assert cover.block_size(4096, 10**6) * 4096 * 8 <= cover.BLOCK_BYTES and cover.block_size(64, 10**6) == cover.BLOCK


def similarity_by_hand(a, b):
    sets = []
    for text in (a, b):
        words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
        sets.append({tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_the_stage_drops_copies_of_similarity_at_least_0_8(spark):
    rng = np.random.default_rng(5)
    rows, near, far = [], [], []
    for i in range(300):
        words = [f"w{x}" for x in rng.integers(0, 3000, 200)]
        rows.append((i, " ".join(words)))
        copy = list(words)
        for at in rng.choice(200, 1 + i % 6, replace=False):
            copy[at] = "edited"
        rows.append((1000 + i, " ".join(copy)))
        (near if similarity_by_hand(*(r[1] for r in rows[-2:])) >= 0.8 else far).append(1000 + i)
    assert len(near) > 100 and len(far) > 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert left >= set(range(300)) | set(far)
    assert len(left & set(near)) <= 0.04 * len(near)


def test_the_stage_finds_copies_that_are_alike_through_one_text_only(spark):
    rng = np.random.default_rng(6)
    rows, texts = [], []
    for hub in range(2):
        words = [f"h{hub}w{x}" for x in rng.integers(0, 3000, 200)]
        texts.append((hub * 10_000 + 5, " ".join(words)))
        for i in range(400 - 300 * hub):
            copy = list(words)
            for at in rng.choice(200, 3, replace=False):
                copy[at] = f"edited{rng.integers(0, 10**9)}"
            texts.append((hub * 10_000 + 10 + i, " ".join(copy)))
    rows = [(10**6 + i, " ".join(f"u{x}" for x in rng.integers(0, 3000, 120))) for i in range(200)]
    assert min(similarity_by_hand(texts[0][1], t) for _, t in texts[1:401]) >= 0.8 > similarity_by_hand(texts[1][1], texts[2][1])
    docs = spark.createDataFrame(texts + rows, "doc_id long, text string").repartition(7)
    left = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert left == {5, 10_005, *(r[0] for r in rows)}


@pytest.mark.parametrize("block", [16, 1024])
def test_the_stage_finds_the_one_pair_that_joins_two_large_groups(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(8)
    texts, joined = [], []
    for family in range(6):
        words = [f"f{family}w{x}" for x in rng.integers(0, 3000, 200)]
        for half in range(2):
            core = list(words)
            for at in (20, 60) if half else (100, 140):
                core[at] = f"half{half}"
            joined.append((len(texts), " ".join(core)))
            texts.append(joined[-1])
            for _ in range(60):
                copy = list(core)
                copy[rng.integers(150, 190)] = f"edited{rng.integers(0, 10**9)}"
                texts.append((len(texts), " ".join(copy)))
    assert similarity_by_hand(texts[0][1], texts[61][1]) >= 0.8 > max(similarity_by_hand(texts[0][1], texts[62][1]), similarity_by_hand(texts[1][1], texts[61][1]), similarity_by_hand(texts[1][1], texts[62][1]))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    left = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert left == {0, 122, 244, 366, 488, 610}


def test_messages_carry_their_own_texts_only(spark):
    """What a text costs hardly grows with the number of owners."""
    rng = np.random.default_rng(7)
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in rng.integers(0, 9000, 60))) for i in range(2000)], "doc_id long, text string").coalesce(1)
    tables, bits = simhash.tables_for(2000, 0.8)
    nodes = simhash.sketches(docs, 5, tables, bits).coalesce(1).withColumn("id", F.monotonically_increasing_id()).withColumn("group", F.col("id"))
    size = lambda owners: simhash.bucket_messages(nodes, tables, bits, owners).agg(F.sum(sum(F.length(c) for c in ("quotients", "remainders", "places", "sketches", "groups")))).first()[0]
    few, many = size(3), size(9)
    assert many < 2 * few, (few, many)


def test_owners_write_a_group_s_texts_not_its_pairs(spark):
    """Of texts that are half alike, five times as many make about five times the rows."""
    rng = np.random.default_rng(9)
    words = [f"w{x}" for x in rng.integers(0, 3000, 200)]
    texts = [" ".join(f"edited{rng.integers(0, 10**9)}" if k in at else w for k, w in enumerate(words)) for at in (set(rng.choice(200, 8, replace=False).tolist()) for _ in range(1000))]
    tables, bits = simhash.tables_for(50_000, 0.8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    nodes = materialise(simhash.sketches(docs, 5, tables, bits).coalesce(1).withColumn("id", F.col("doc_id")), "nodes")
    found = [simhash.candidates(nodes.where(F.col("id") < n), tables, bits, 0.8) for n in (200, 1000)]
    few, many = (df.agg(F.sum(F.greatest(F.size("members"), F.lit(1)) if "members" in df.columns else F.lit(1))).first()[0] for df in found)
    assert 0 < many < 8 * few, (few, many)


@pytest.mark.parametrize("drop", [golomb_dedup.drop_exact, simhash.drop_near, simhash.drop_similar])
def test_rows_drop_by_id_and_text(spark, drop):
    texts = [" ".join(f"t{i}w{k}" for k in range(40)) for i in range(4)]
    a, b, c, d = texts
    # Null-id copy of a beside unique null-id b; ids 7 and 8 repeat, with other and with equal texts; nulls only have d.
    rows = [(1, a), (None, a.upper()), (None, b), (7, a), (7, c), (8, "same row " * 9), (8, "same row " * 9), (None, d), (None, d)]
    left = drop(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    best = 7 if drop is golomb_dedup.drop_exact else 1
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left) == sorted([(best, a), (0, b), (7, c), (8, "same row " * 9), (0, d)])


def test_digests_of_spark_and_python_agree(spark):
    docs = spark.createDataFrame([(k, "Aé" * k) for k in range(70)] + [(None, None)], "doc_id long, text string")
    there = {r["doc_id"]: r["digest"] for r in docs.select("doc_id", text_digest()).collect()}
    assert there == {r["doc_id"]: r["print"] for r in golomb_dedup.digests(docs).collect()}
