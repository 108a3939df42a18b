"""Near-duplicate classes against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsieve.llm import minhash as M
from tests.llm.brute import near_classes

HASHES = np.array([1 << 60, 1 << 61, 1 << 62], np.uint64)
WEIGHTS = np.array([2.0, 3.0, 5.0], np.float32)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    shared = [" ".join(rng.choices(vocabulary, k=40)) for _ in range(4)]
    texts = []
    for _ in range(60):
        base = rng.choices(vocabulary, k=rng.randint(3, 200))
        texts.append(" ".join(base) + rng.choice(["", " " + rng.choice(shared)]))
        for _ in range(rng.choice([0, 0, 1, 6])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    hot = rng.choices(vocabulary, k=150)
    for _ in range(60):
        copy = list(hot)
        copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    texts += [" ".join(hot)] * 40
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(spark, seed):
    rows = corpus(seed)
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert {r.doc_id: r.class_id for r in got} == near_classes(rows)


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.class_id for r in M.near_duplicates(docs).collect()}
    assert got == near_classes([tuple(r) for r in docs.collect()])


def test_edges(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [(7, None, 1), (8, "", 2), (9, "a b", 3), (9, "a b", 3), (3, "a b", 4), (None, "c", 5), (None, None, 6), (5, long, 7), (6, long + " end", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int")
    got = sorted(((r.doc_id, r.class_id) for r in M.near_duplicates(df).collect()), key=str)
    assert got == sorted([(7, 7), (8, 7), (9, 3), (9, 3), (3, 3), (None, None), (None, 7), (5, 5), (6, 5)], key=str)
    kept = sorted((r.node for r in M.keep_first(df).collect()))
    assert kept == [1, 4, 5, 7] and M.keep_first(df).columns == df.columns
    assert M.near_duplicates(df.limit(0)).count() == 0 and M.keep_first(df.limit(0)).count() == 0


def test_equal_rows_leave_one(spark):
    df = spark.createDataFrame([(1, "x y z"), (1, "x y z"), (1, "other words")], "doc_id long, text string")
    assert sorted(r.text for r in M.keep_first(df).collect()) == ["other words", "x y z"]


def test_samples_agree_as_weights_do():
    rng = np.random.default_rng(0)
    hashes = rng.integers(1, 1 << 63, 50).astype(np.uint64)
    a, b = rng.random(50) + 0.1, rng.random(50) + 0.1
    s = M.icws(np.concatenate([hashes, hashes]), np.concatenate([a, b]), np.array([0, 50]), 4000)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_band_that_only_seems_shared_loses_no_pair(spark):
    # Texts 2 and 3 have the same codes in band 0, which is another bucket, and share band 1.
    code, load = bytes(range(8)), M.slot_loads(HASHES, WEIGHTS).tobytes()
    bands = {1: [10, 20], 2: [11, 20], 3: [12, 20]}
    rows = [(node, float(WEIGHTS.sum()), code, keys, load) for node, keys in bands.items()]
    sketches = spark.createDataFrame(rows, "node long, weight double, code binary, bands array<long>, load binary")
    members = sketches.select("node", "weight", "code", F.posexplode("bands").alias("no", "band"))
    labels = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "node long, component long")
    pairs = M._cross_pairs(members, sketches, labels, 0.8, False)
    assert {(r.a, r.b) for r in pairs.collect()} == {(1, 2), (1, 3), (2, 3)}


def test_loads_never_rule_out_a_similar_pair():
    # Whatever the samples say: pairs around the threshold, of few and of many terms.
    rng = np.random.default_rng(1)
    ruled_out = 0
    for n in [1, 3, 40, 400, 20_000] * 40:
        hashes = rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        a = (rng.random(n) * 12 + 1e-3).astype(np.float32)
        b = np.where(rng.random(n) < rng.uniform(0.7, 1), a, 0).astype(np.float32)
        similarity = np.minimum(a, b).sum(dtype=float) / np.maximum(a, b).sum(dtype=float)
        one, other = (M.slot_loads(hashes[w > 0], w[w > 0]).astype(np.float32) for w in (a, b))
        may = M.may_link(one[None], np.array([a.sum(dtype=float)]), other, b.sum(dtype=float), 0.8)[0]
        assert may or similarity < 0.8
        ruled_out += not may
    assert ruled_out


def test_loads_beyond_half_precision_rule_nothing_out():
    load = M.slot_loads(np.full(2, 7, np.uint64), np.array([60_000, 60_000], np.float32))
    assert np.isinf(load[0]) and not load[1:].any()
    wide = load.astype(np.float32)
    assert M.may_link(wide[None], np.array([120_000.0]), wide, 120_000.0, 0.8)[0]
