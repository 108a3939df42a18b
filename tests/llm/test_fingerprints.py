"""Fingerprints: edited texts, likeness against the true similarity, edges."""

import hashlib
import random

from pyspark.sql import functions as F

from mailsieve.llm import fingerprints as P
from tests.llm.brute import edited_text, word_similarity


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    got = {r.id: r for r in P.fingerprints(docs.repartition(5)).collect()}
    errors = []
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        other, r = edited_text(text, following), got[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(other.encode()).hexdigest()
        assert 0 <= r.near_next <= 1 and abs(r.near_next - word_similarity(text, following)) < 0.25
        errors.append(r.near_edited - word_similarity(text, other))
    assert abs(sum(errors) / len(errors)) < 0.02 and sum(map(abs, errors)) / len(errors) < 0.06


def test_share_of_equal_samples_is_the_similarity(spark):
    rng = random.Random(1)
    bags = []
    for i in range(60):
        base = [f"w{i}.{rng.randint(0, 400)}" for _ in range(600)]
        bags.append((i, " ".join(base), " ".join(base[: 10 * i] + [f"v{i}.{rng.randint(0, 400)}" for _ in range(600 - 10 * i)])))
    df = spark.createDataFrame(bags, "id long, a string, b string")
    df = P.with_fingerprint(P.with_fingerprint(df, "a", "x"), "b", "y")
    out = {r[0]: r[1] for r in df.select("id", P.likeness(F.col("x"), F.col("y"))).collect()}
    errors = [out[i] - word_similarity(a, b) for i, a, b in bags]
    assert abs(sum(errors) / len(errors)) < 0.02 and max(map(abs, errors)) < 0.17


def test_edges(spark):
    rows = [(None, "null id here"), (1, None), (2, ""), (3, "a b c d"), (3, "a b c d"), (4, "x"), (5, "word " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = P.fingerprints(df).orderBy("id", "near_next").collect()
    assert len(out) == 7
    by_id = {r.id: r for r in out}
    assert by_id[1].fingerprint == "" and by_id[1].near_edited == 1.0 and by_id[1].near_next == 1.0
    assert [r.near_next for r in out if r.id == 3] == [0.0, 1.0]
    assert len({r.fingerprint for r in out if r.id == 3}) == 1
    assert by_id[5].n_chars == 200_000
    assert P.fingerprints(df.limit(0)).count() == 0


def test_one_document_follows_itself(spark):
    df = spark.createDataFrame([(9, "abcd efgh ijkl mnop", "z", 1)], "doc_id long, text string, bucket string, guest int")
    (r,) = P.fingerprints(df).collect()
    want = edited_text("abcd efgh ijkl mnop", "abcd efgh ijkl mnop")
    assert r.edited_sha256 == hashlib.sha256(want.encode()).hexdigest() and r.near_next == 1.0
