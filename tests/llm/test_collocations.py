"""Collocations against phrases counted one by one, and the trie's parts on their own."""

import random
import re
from collections import Counter, defaultdict

import pytest

from mailsieve.llm import collocations as C


def brute(rows, least, longest=5, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if " " in p and a >= least}
        rows_of = []
        for p, a in cand.items():
            if any(100 * b >= 100 * a and f" {p} " in f" {q} " and q != p for q, b in cand.items()):
                continue
            w = p.split(" ")
            cuts = []
            for k in range(1, len(w)):
                left, right = counts[" ".join(w[:k])], counts[" ".join(w[k:])]
                cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            rows_of.append((-score, -a, p.encode(), left, right))
        for i, (score, a, p, left, right) in enumerate(sorted(rows_of)[:top], 1):
            out.append((lang, i, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def texts(seed: int, n: int) -> list[tuple[str | None, str | None]]:
    rng = random.Random(seed)
    words = ["New", "york", "CITY", "the", "of", "é", "Straße", "日本", "x1", "'s", "<|", "a b"]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 30)):
            parts.append(rng.choice(words) if rng.random() < 0.6 else "New York city of")
            parts.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?"]))
        rows.append((rng.choice(["en", "de", None]), "".join(parts)))
    return rows + [("en", None), ("fr", ""), (None, "..."), ("en", "one"), ("en", "same row same row")] + [("en", "same row same row")] * 5


def check(spark, rows, least, **more):
    docs = spark.createDataFrame([(lang, text, 1, "z") for lang, text in rows], "lang string, text string, n int, phrase string").repartition(5)
    got = C.collocations(docs, least=least, **more)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, least, **more)


@pytest.mark.parametrize("least", [2, 12])
def test_against_brute_force(spark, least):
    check(spark, texts(least, 120), least)


def test_bursts_and_spills(spark, monkeypatch):
    """Tiny containers, tries and vocabularies give the same counts; so does a table of
    few bits, in which rare phrases look frequent."""
    for name, value in {"BURST": 3, "MOST": 40, "MOST_WORDS": 9, "PIECE": 200, "BITS": 8, "HEADS": 30, "PARTS": 7}.items():
        monkeypatch.setattr(C, name, value)
    check(spark, texts(5, 80), 3)
    check(spark, texts(6, 80), 3, top=4, longest=3)


def test_trie():
    trie, want = C.Trie(), Counter()
    rng = random.Random(0)
    for _ in range(20_000):
        ids = [rng.randint(0, 40) for _ in range(rng.randint(1, 5))]
        rest = b"".join(i.to_bytes(C.ID, "big") for i in ids[1:])
        trie.add((0, ids[0]), [rest], [2])
        want[b"".join(i.to_bytes(C.ID, "big") for i in ids)] += 2
    assert trie.total == len(want)
    firsts = trie.largest(len(want) // 2)
    def drained(firsts):
        return {head.to_bytes(C.ID, "big") + rest: n for _, head, rests, counts in trie.drain(firsts) for rest, n in zip(rests, counts)}

    out = Counter(drained(firsts))
    assert trie.total <= len(want) // 2 and sum(trie.sizes.values()) == trie.total
    out.update(drained(list(trie.root)))
    assert out == want and trie.total == 0


def test_empty_and_long(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert C.collocations(empty).collect() == []
    long = "alpha beta gamma delta " * 50_000
    rows = C.collocations(spark.createDataFrame([("en", long)], "lang string, text string"), least=100).collect()
    # The text has no separator, so the four phrases of five words hold all shorter ones
    # that occur as often.
    assert rows and all(r["n"] == 200_000 for r in rows)
    assert sorted(tuple(r) for r in rows) == brute([("en", long)], 100)


def test_large_products(spark):
    """1000 * a * n beyond 64 bits."""
    every = spark.createDataFrame([("en", "a b", 9_000_000_000_000), ("en", "a", 9_000_000_000_001), ("en", "b", 9_100_000_000_000)], "lang string, phrase string, a long")
    totals = spark.createDataFrame([("en", 40_000_000_000_000)], "lang string, n long")
    row = C.scored(every, totals).first()
    assert row["score"] == 1000 * 9_000_000_000_000 * 40_000_000_000_000 // (9_000_000_000_001 * 9_100_000_000_000)

