"""Token alignment against intervals compared one by one, and the other library's ids."""

import hashlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

from mailsieve.llm import alignment
from mailsieve.llm.queries import BYTE_FILE, PIECE_MODEL

TEXTS = [
    "The quick brown fox, naïve café — 日本語テキスト 🙂!", "", None, " ", "  two  spaces\n\nand\ttabs \r\n", "<|endoftext|> is <s>plain</s> text <0x41>",
    "The quick brown fox", "The quick brown fox", "a" * 300, "▁ mark", "don't we'll I'M", "word " * 40, "нет हिन्दी ok\x00zero", "   wide", "ﬁ ligature é",
]


@pytest.fixture(scope="module")
def pair():
    return alignment.load(BYTE_FILE, PIECE_MODEL)


def brute(texts, pair):
    """Rows of linked() and the overlaps, from every pair of tokens of a text."""
    a_tool = Tokenizer.from_file(BYTE_FILE)
    a_tool.encode_special_tokens = True
    _, a_bytes, b_tool, b_bytes = pair.tools()
    found = []
    for text in texts:
        want = (" " + (text or "")).encode()
        sides = [a_tool.encode(" " + text, add_special_tokens=False).ids, b_tool.encode(text)] if text else [[], []]
        if any(b"".join(table[i] for i in ids) != want for ids, table in zip(sides, (a_bytes, b_bytes))):
            sides = [[], []]
        spans = []
        for ids, table in zip(sides, (a_bytes, b_bytes)):
            at, out = 0, []
            for i in ids:
                out.append((i, at, at + len(table[i])))
                at += len(table[i])
            spans.append(out)
        a, b = spans
        over = [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[1] < y[2] and y[1] < x[2]]
        links = [(x[0], y[0]) for x in a for y in b if x[2] == y[2]]
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        parts, begin = [], 0
        for end in ends:
            parts.append("|".join(",".join(str(t[0]) for t in side if begin < t[2] <= end) for side in spans))
            begin = end
        found.append((spans, over, links, ";".join(parts)))
    counts = Counter(link for one in found for link in one[2])
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    rows = []
    for (a, b), over, links, text in found:
        rows.append(
            (len(a), len(b), text.count("|"), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
             len(over), hashlib.sha256(text.encode()).hexdigest() if text else "")
        )
    return rows, found, counts


def test_against_brute_force(spark, pair):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_a string, pairs string")
    rows, found, counts = brute(TEXTS, pair)
    got = sorted(alignment.linked(docs, pair).collect())
    assert [tuple(r)[1:] for r in got] == rows
    whole = sorted(alignment.align(docs, pair, whole=True).collect())
    for r, ((a, b), over, _, text) in zip(whole, found):
        assert r["groups"] == text
        assert list(zip(r["over_a"], r["over_b"])) == over
        assert [t[0] for t in a] == r["a_ids"] and [t[2] for t in a] == r["a_ends"]
        assert [t[0] for t in b] == r["b_ids"] and [t[2] for t in b] == r["b_ends"]
    table = alignment.pair_counts(alignment.align(docs, pair)).collect()
    assert {(r["pair"] // pair.width, r["pair"] % pair.width): r["n"] for r in table} == counts


def test_tables_and_ids(spark, pair):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.linked(empty, pair).collect() == []
    docs = spark.createDataFrame([(None, "same text"), (None, "same text"), ("k", None)], "doc_id string, text string")
    rows = alignment.linked(docs, pair).collect()
    assert len(rows) == 3 and len({r["groups_sha256"] for r in rows}) == 2


def test_long_text_and_bound(spark, pair):
    long = "one more word of many, " * 60_000
    row = alignment.linked(spark.createDataFrame([(1, long)], "doc_id long, text string"), pair).first()
    assert row["n_links"] == row["n_groups"] > 300_000 and row["n_best"] <= row["n_links"]
    assert pair.bound() < 400_000


def test_documents(spark, small, pair):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    rows, _, _ = brute([r["text"] for r in docs.orderBy("doc_id").collect()], pair)
    assert [tuple(r)[1:] for r in sorted(alignment.linked(docs, pair).collect())] == rows
