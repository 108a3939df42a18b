"""Nearest copies: runs travel packed, and the pairs are those of a plain count."""

import random
from collections import Counter

import pytest

from mailsieve.operators import curation as C
from tests.test_plans import exchanges


def plain(rows, n):
    """key, other, similarity of rows by counting; keys may repeat."""
    sets = []
    for key, text in rows:
        words = (text or "").lower().split()
        if key is not None and words:
            sets.append((key, {tuple(words[i : i + n]) for i in range(max(len(words) - n, 0) + 1)}))
    owner = {}
    for key, runs in sets:
        for run in runs:
            owner[run] = min(owner.get(run, key), key)
    counts = {}
    for key, runs in sets:
        counts.setdefault(key, Counter()).update(owner[r] for r in runs if owner[r] < key)
    found = []
    for key, runs in sets:
        if counts[key]:
            best = min(counts[key], key=lambda o: (-counts[key][o], o))
            found += [(key, best, len(runs & r) / len(runs | r)) for other, r in sets if other == best]
    return sorted(found)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_copies_are_those_of_a_plain_count(spark, monkeypatch, kind):
    monkeypatch.setattr(C, "PACKED_RUNS", 50)
    monkeypatch.setattr(C, "MOST_PAIRS", 5)  # more go by a join
    rng = random.Random(7)
    rows = []
    for i in range(60):
        words = [rng.choice("abé") for _ in range(rng.choice([0, 1, 3, 6, 20, 40]))]
        if rows and rng.random() < 0.5 and rng.choice(rows)[1]:
            old = (rng.choice(rows)[1] or "").split()
            words = old[: rng.randint(0, len(old))] + words[:4]
        rows.append((i if kind == "long" else f"k{i % 57}", rng.choice([" ", "\n", " 　"]).join(words)))
    rows += [rows[20], (rows[30][0], "a b a b é a a"), (None, rows[5][1]), ("z" if kind == "string" else 99, None)]
    df = spark.createDataFrame(rows, f"id {kind}, text string")
    for n in (3, 5):
        assert sorted(tuple(r) for r in C.nearest_copy(df.repartition(3), "id", n=n).collect()) == plain(rows, n)


def test_nothing_shared_and_nothing_there(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None), (3, "d e f")], "id long, text string")
    assert C.nearest_copy(df, "id").collect() == []
    assert C.nearest_copy(df.filter("id = 2"), "id").collect() == []


def test_copies_move_no_row_per_run(spark, monkeypatch):
    seen, written = [], C.written
    monkeypatch.setattr(C, "written", lambda df, name: seen.append(exchanges(df)) or written(df, name))
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f")], "id long, text string")
    seen.append(exchanges(C.nearest_copy(df, "id")))
    moved = [set(names) for found in seen for names in found]
    assert not any("_run" in names or "_runs" in names for names in moved)
    assert {"part", "blob"} in moved and {"bucket", "blob"} in moved
