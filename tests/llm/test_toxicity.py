"""Toxicity: features and learning against plain Python, and accuracy on the held-out rows."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mailsieve.llm import tokens, toxicity

TEXTS = ["you idiot of a clown", "", "one", "one two", "éclair naïve ça va 日本語", "a b a b a b", "word " * 30]


def hash_of(word: str) -> int:
    out, up = 0, 1
    for byte in word.encode():
        out = (out + (byte + 1) * up) % 2**64
        up = up * tokens.BASE % 2**64
    return int(tokens.mix(np.array([out], np.uint64))[0])


def mixed(x: int) -> int:
    return int(tokens.mix(np.array([x % 2**64], np.uint64))[0])


def plain_features(text: str) -> Counter:
    words = text.split()
    found = [hash_of(w) for w in words]
    hashes = list(found)
    for step in (1, 2):
        found += [mixed(a * tokens.BASE + b + step) for a, b in zip(hashes, hashes[step:])]
    for chars in toxicity.STEMS:
        found += [mixed(hash_of(w[:chars]) + 100 + chars) for w in words]
    return Counter(h % (1 << toxicity.BITS) for h in found)


def test_features(monkeypatch):
    of, places, counts = toxicity.features(pa.array(TEXTS))
    for i, text in enumerate(TEXTS):
        assert dict(zip(places[of == i].tolist(), counts[of == i].tolist())) == plain_features(text)
    monkeypatch.setattr(toxicity, "SPAN", 7)
    long = " ".join(f"w{i % 23} x{i % 5}" for i in range(60))
    _, places, counts = toxicity.features(pa.array([long]))
    assert dict(zip(places.tolist(), counts.tolist())) == plain_features(long)


def plain_learn(rows, s, size):
    """One coordinate after the other, as FTRL-proximal is published."""
    z, n = [0.0] * size, [0.0] * size

    def weight(i):
        l1 = 0.0 if i == size - 1 else s.l1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    for label, x in rows:
        x = {**x, size - 1: 1.0}
        w = {i: weight(i) for i in x}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
        for i, v in x.items():
            g = (p - label) * v
            step = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / s.alpha
            z[i] += g - step * w[i]
            n[i] += g * g
    return z, n


def test_learning():
    rng = np.random.default_rng(1)
    s = toxicity.Settings(l1=0.3)
    rows = []
    for _ in range(80):
        places = np.sort(rng.choice(20, 6, replace=False))
        rows.append((int(places[0] < 3), places, rng.random(6) * 3))
    z, n = toxicity.learn(rows, np.zeros(21), np.zeros(21), s)
    want = plain_learn([(y, dict(zip(p.tolist(), x.tolist()))) for y, p, x in rows], s, 21)
    assert np.allclose(z, want[0]) and np.allclose(n, want[1])
    assert (toxicity.weights_of(z, n, s, s.l1) == 0).any()


def test_rounds_average_blocks(spark, monkeypatch):
    """A pass over several blocks gives the mean of their sums by rows."""
    monkeypatch.setattr(toxicity, "BLOCK_DOCS", 8)
    rows = [(i, i % 3 == 0, ("bad vile words " if i % 3 == 0 else "good kind words ") + f"n{i % 7}") for i in range(40)]
    table = spark.createDataFrame([(i, int(y), t) for i, y, t in rows], "id long, label int, text string")
    packed = toxicity.blocks(table, 40)
    held = packed.collect()
    assert sum(len(r["labels"]) for r in held) == 40 and len(held) >= 5
    size, s = (1 << toxicity.BITS) + 1, toxicity.Settings()
    z, n, seen = toxicity._pass(packed, np.zeros(size), np.zeros(size), s)
    total = np.zeros(size)
    for r in held:
        cut = [*r["starts"], len(r["places"])]
        own = [(y, np.array(r["places"][a:b]), toxicity.values(np.zeros(b - a, int), np.array(r["counts"][a:b]), 1)) for y, a, b in zip(r["labels"], cut, cut[1:])]
        total += toxicity.learn(own, np.zeros(size), np.zeros(size), s)[0] * len(own)
    assert seen == 40 and np.allclose(z, total / 40)


def test_edge_rows(spark):
    docs = spark.createDataFrame(
        [(1, "vile trash", 9.0), (1, "vile trash", 9.0), (2, None, 1.0), (3, "", 1.0), (None, "vile trash", 1.0), (4, "calm words", 1.0)],
        "doc_id long, text string, score double",
    )
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (4, 0), (3, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.predict(docs, model, keep=("doc_id", "score")).collect()
    assert len(rows) == 6 and rows[0].asDict().keys() == {"doc_id", "score", "predicted"}
    by_text = {(r["doc_id"]): r["score"] for r in rows}
    assert by_text[1] == by_text[None] and by_text[2] == by_text[3]
    empty = toxicity.fit(docs, labels.limit(0))
    assert {(r["score"], r["predicted"]) for r in toxicity.predict(docs, empty).collect()} == {(0.0, 0)}
    assert toxicity.predict(docs.limit(0), model).collect() == []


def test_sample_is_bounded(spark):
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 9 == 0).cast("int").alias("toxic"))
    n = toxicity.chosen(labels, "doc_id", "toxic", 500).count()
    assert 400 < n < 600


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.1"])
def test_held_out_accuracy(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    assert len(model.places) < 10_000
    test = docs.join(labels.filter(toxicity.held_out(F.col("doc_id"))), "doc_id")
    rows = toxicity.predict(test, model, keep=("doc_id", "toxic")).collect()
    toxic, clean = ([r["predicted"] for r in rows if r["toxic"] == y] for y in (1, 0))
    assert sum(toxic) / len(toxic) > 0.9 and sum(clean) / len(clean) < 0.01
    assert all(re.fullmatch("[01]", str(p)) for p in toxic)
