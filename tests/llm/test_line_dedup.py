"""Similar lines against all pairs."""

import random

import pytest

from mailsieve.llm import line_dedup as D
from tests.llm.brute import near_lines


def corpus(seed):
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(4000)]

    def line(n):
        return [rng.choice(common) if rng.random() < 0.6 else rng.choice(rare) for _ in range(n)]

    bases = [line(rng.choice([1, 2, 3, 5, 8, 20, 60, 150])) for _ in range(120)]
    rows = []
    for i in range(150):
        lines = []
        for _ in range(rng.randint(0, 8)):
            words = list(rng.choice(bases)) if rng.random() < 0.6 else line(rng.randint(1, 30))
            for _ in range(rng.choice([0, 0, 1, 2, 1 + len(words) // 8])):
                words[rng.randrange(len(words))] = rng.choice(rare)
            rng.shuffle(words) if rng.random() < 0.1 else None
            lines.append(rng.choice(["", " ", "\t"]) + " ".join(words))
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("eager", [False, True])
def test_against_all_pairs(spark, monkeypatch, seed, eager):
    if eager:  # every search ends early, so the way for the rest has to do the work
        monkeypatch.setattr(D, "STRONG", 1.0)
        monkeypatch.setattr(D, "SLACK", 0.0)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {(r.id, r.line_no) for r in D.similar_lines(df).collect()} == near_lines(rows)


def test_one_candidate_at_first(spark, monkeypatch):
    monkeypatch.setattr(D, "TRIED", 1)
    monkeypatch.setattr(D, "LIKELY", 1.0)
    rows = corpus(9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.id, r.line_no) for r in D.similar_lines(df).collect()} == near_lines(rows)


def test_texts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    gone = near_lines(rows)
    for r in D.dedup(docs).collect():
        full = dict(rows)[r.doc_id].split("\n")
        assert r.text == "\n".join(x for i, x in enumerate(full) if (r.doc_id, i) not in gone)
        assert r.n_removed == sum((r.doc_id, i) in gone for i in range(len(full)))


def test_edges(spark):
    line = " ".join(f"k{i}" for i in range(30))
    rows = [
        (None, line + " z", 1), (2, line, 2), (2, line, 2), (3, None, 3), (4, "\n\n", 4), (5, line + " y\nown words", 5), (6, "k " * 70_000, 6),
        (7, f"{line}\nonly", 7),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone int")
    got = {r.gone: (r.doc_id, r.text, r.n_removed) for r in D.dedup(df).collect()}
    assert got[1] == (None, "", 1) and got[2] == (2, line, 0) and got[3] == (3, None, 0) and got[4] == (4, "\n\n", 0)
    assert got[5] == (5, "own words", 1) and got[6][2] == 0 and got[7] == (7, "only", 1)
    assert D.dedup(df).count() == 8 and D.dedup(df.limit(0)).count() == 0


def test_hot_words_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(D, "HOT", 8)
    monkeypatch.setattr(D, "SAMPLED", 1.0)
    rows = corpus(4) + [(1000 + i, f"t1 t2 t3 t4 t5 t6 t7 t8 t9 own{i}\nt1 t2 t3 t4 mine{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {(r.id, r.line_no) for r in D.similar_lines(df).collect()} == near_lines(rows)


def test_template_lines_give_few_candidates():
    import numpy as np
    import pyarrow as pa

    for words in (5, 10, 12, 30):
        template = " ".join(f"t{i}" for i in range(words - 1))
        texts = pa.array([f"own{i} {template}" for i in range(1500)])
        ranks = np.zeros(1 << D.SKETCH_BITS, np.uint16)
        for w in template.split():
            ranks[D.tokens.words(pa.array([w])).hashes >> np.uint64(64 - D.SKETCH_BITS)] = 1000
        x = D.Lines(texts, ranks, D.THRESHOLD)
        line = np.repeat(np.arange(len(x.n)), x.prefix)
        pos = np.arange(len(line)) - np.repeat(np.cumsum(x.prefix) - x.prefix, x.prefix)
        lines = [x.text.astype(np.int64), np.zeros(len(x.n), np.uint32), x.line_no.astype(np.uint32), x.n.astype(np.uint32), (x.a >> np.uint64(32)).astype(np.uint32), x.bits.ravel()]
        found = D._candidates(x.words[x.starts[line] + pos], pos, line, lines, D.THRESHOLD)
        assert len(found) <= D.OTHERS * 1500
        # J is below the threshold for 5 words; otherwise every line but the first has one.
        assert found["id"].nunique() == (0 if words == 5 else 1499)


def test_texts_without_id_are_told_apart_by_the_whole_digest(spark):
    # The digests of these two have their lower 32 bits in common.
    a = "first10109 of its own words\nthe line that an earlier text holds too"
    b = "second345358 of other words\nnothing like it is anywhere else345358"
    df = spark.createDataFrame([(1, "the line that an earlier text holds too"), (None, a), (None, b)], "doc_id long, text string")
    out = {r.text for r in D.dedup(df).filter("doc_id IS NULL").collect()}
    assert out == {a.split("\n")[0], b}


def test_the_largest_id_comes_before_rows_without_one(spark):
    line, most = " ".join(f"k{i}" for i in range(30)), 2**63 - 1
    rows = [(most, line + " x", 1), (1, line, 2), (None, line + " y\nfirst of its kind", 3), (most, "first of its kind", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, no int")
    got = {r.no: (r.doc_id, r.text, r.n_removed) for r in D.dedup(df).collect()}
    assert got == {1: (most, "", 1), 2: (1, line, 0), 3: (None, "", 2), 4: (most, "first of its kind", 0)}


def test_more_texts_than_go_to_every_task(spark, monkeypatch):
    monkeypatch.setattr(D, "SMALL", 0)
    monkeypatch.setattr(D, "BITS", 10)
    monkeypatch.setattr(D, "STRONG", 1.0)
    monkeypatch.setattr(D, "SLACK", 0.0)
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {(r.id, r.line_no) for r in D.similar_lines(df).collect()} == near_lines(rows)


def test_entries_travel_small():
    """The bitmap of a line goes with its entries into each range; well under what the
    fields take as they are."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)
    texts = ["\n".join(" ".join(f"w{rng.randrange(50_000)}" for _ in range(rng.choice([12, 25, 60]))) for _ in range(20)) for _ in range(60)]
    x = D.Lines(pa.array(texts), np.zeros(1 << D.SKETCH_BITS, np.uint16), D.THRESHOLD)
    ids, digest = x.text.astype(np.int64), x.text.astype(np.int64) * 7919
    out = list(D._entry_rows(x, ids, digest, np.ones(len(x.n), bool), 8, None))
    fields = [D.unpack(D._unpressed(blob), *D.ENTRY) for _, blob in out]
    assert sum(len(f[0]) for f in fields) == x.prefix.sum()
    whole = sum(14 * len(f[0]) + 60 * len(f[3]) for f in fields)
    assert sum(len(blob) for _, blob in out) <= 0.6 * whole
    for f in fields:
        place = np.cumsum(f[2], dtype=np.int64) - 1
        assert place[0] == 0 and place[-1] == len(f[3]) - 1
