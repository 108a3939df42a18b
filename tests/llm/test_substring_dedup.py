"""Repeated lines against plain code."""

import random
import re

from mailsieve.llm import substring_dedup as D


def plain(rows, least):
    seen, out = {}, {}
    for doc_id, text in sorted(rows):
        kept, removed, at = [], [], 0
        for line in text.split("\n"):
            key = " ".join(line.lower().split())
            if len(key.split()) >= least and key in seen:
                removed.append(f"{at}:{at + len(line)}:{seen[key]}")
            else:
                kept.append(line)
                if len(key.split()) >= least:
                    seen[key] = doc_id
            at += len(line) + 1
        out[doc_id] = ("\n".join(kept), len(removed), ",".join(removed))
    return out


def test_against_plain_code(spark):
    line = "some passage of words that many documents share é🎉 %d"
    rows = [(i, "\n".join((line % ((i * k) % 7)).upper() if k % 2 else line % ((i * k) % 7) + "  " for k in range(i % 9))) for i in range(60)]
    rows += [(100, "short\nshort\nshort"), (101, (line % 3 + "\n") * 2500)]
    out = D.dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_words=5).collect()
    assert {r.doc_id: (r.text, r.n_removed, r.removed) for r in out} == plain(rows, 5)


def test_long_passage_in_the_middle_is_caught_once(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"own words of {i}\n{passage}\nmore own words {i}") for i in range(30)]
    out = D.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in out if passage in r.text] == [0]
    assert all(f"own words of {r.doc_id}" in r.text and f"more own words {r.doc_id}" in r.text for r in out)


def test_edges(spark):
    text = " ".join(["x"] * 25)
    rows = [(None, text, 1), (3, text, 2), (3, text, 2), (4, None, 3), (5, "", 4), (6, f"{text}\n{text}", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed int")
    out = sorted(((r.doc_id is None, r.doc_id or 0, r.text, r.n_removed, r.removed) for r in D.dedup(df).collect()), key=str)
    # Equal rows are one document; a NULL id comes last.
    assert out == sorted(
        [
            (True, 0, "", 1, "0:49:3"), (False, 3, text, 0, ""), (False, 3, text, 0, ""), (False, 4, None, 0, ""),
            (False, 5, "", 0, ""), (False, 6, "", 2, "0:49:3,50:99:3"),
        ],
        key=str,
    )
    assert D.dedup(df.limit(0)).count() == 0


def test_passage_of_short_lines(spark):
    lines = [" ".join(f"w{i}" for i in range(k, k + 7)) for k in range(0, 56, 7)]
    han = "".join(chr(0x4E00 + 7 * i) for i in range(60))
    rows = [(i, "\n".join([f"own words of {i}", *lines, "", f"more own words {i}", han])) for i in range(8)]
    rows.append((8, "\n".join(["one word"] * 100)))
    out = {r.doc_id: r for r in D.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0].text == rows[0][1] and out[0].n_removed == 0
    for i in range(1, 8):
        assert out[i].text == f"own words of {i}\n\nmore own words {i}" and out[i].n_removed == 9
        at = len(f"own words of {i}\n")
        assert out[i].removed.split(",")[0] == f"{at}:{at + len(lines[0])}:0"
    # Runs of a text that overlap the first of their kind are no repeats.
    assert out[8].text == "\n".join(["one word"] * 10) and out[8].n_removed == 90


def test_runs_against_plain_code(spark):
    import random

    rng = random.Random(5)
    blocks = [[" ".join(rng.choices("abcdefghijkl", k=rng.randint(0, 6))) for _ in range(6)] for _ in range(5)]
    rows = [(i, "\n".join(x for _ in range(4) for x in rng.choice(blocks) + [f"own {rng.random()}"])) for i in range(25)]
    first, gone = {}, {i: set() for i, _ in rows}
    for doc_id, text in rows:
        lines = [" ".join(x.split()) for x in text.split("\n")]
        n = [len(x.split()) for x in lines]
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                if n[i] and n[j] and sum(n[i : j + 1]) >= 9 and (sum(n[i:j]) < 9 or sum(n[i + 1 : j + 1]) < 9):
                    key = " ".join(x for x in lines[i : j + 1] if x)
                    d, _, last = first.setdefault(key, (doc_id, i, j))
                    if d != doc_id or i > last:
                        gone[doc_id] |= set(range(i, j + 1))
    out = D.dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_words=9).collect()
    texts = dict(rows)
    for r in out:
        assert r.text == "\n".join(x for i, x in enumerate(texts[r.doc_id].split("\n")) if i not in gone[r.doc_id])
    assert sum(map(len, gone.values())) > 100


def whole_rule(rows, least, min_words):
    """Passages and runs of lines in plain Python: what goes from each text."""
    import numpy as np

    from mailsieve.llm import tokens

    def mixed(x):
        return int(tokens.mix(np.array([x % 2**64], np.uint64))[0])

    def poly(values):
        out, up = 0, 1
        for v in values:
            out, up = (out + v * up) % 2**64, up * tokens.BASE % 2**64
        return out

    first, found = {}, []
    for doc_id, text in rows:
        words = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(f"[{D.UNSPACED}]|[^ \t-\r{D.UNSPACED}]+", text)]
        hashes = [mixed(poly([ord(c) + 1 for c in w])) for _, _, w in words]
        halves = [[mixed(poly([mixed(h + salt * tokens.BASE) for h in hashes[i : i + D.WINDOW]]) + salt) for i in range(len(words) - D.WINDOW + 1)] for salt in (0, 1)]
        key, span = halves[0], least - D.WINDOW + 1
        picks = set()
        for j in range(max(1, len(key) - span + 1)):
            part = key[j : j + span]
            picks |= {j + i for i, k in enumerate(part) if k == min(part)}
        picks = sorted(picks)
        for i, after in zip(picks, picks[1:] + [None]):
            bridge = None if after is None else " ".join(w for _, _, w in words[i : after + D.WINDOW])
            end = words[(i if after is None else after) + D.WINDOW - 1][1]
            found.append((doc_id, words[i][0], words[i + D.WINDOW - 1][1], (halves[0][i], halves[1][i]), bridge, end))
    for doc_id, a, b, unit, bridge, _ in sorted(found, key=lambda x: x[:2]):
        first.setdefault(unit, (doc_id, a, b, bridge))
    spans = {}
    for doc_id, a, b, unit, bridge, end in found:
        d, _, stop, other = first[unit]
        if d != doc_id or a >= stop:
            spans.setdefault(doc_id, []).append((True, a, end if bridge and bridge == other else b, str(d)))
    seen, lines_gone = {}, {}
    for doc_id, text in rows:
        lines = [" ".join(x.lower().split()) for x in text.split("\n")]
        for i, j in sorted(D.spans([len(D.COUNTED.findall(x)) for x in lines], min_words)):
            unit = " ".join(x for x in lines[i : j + 1] if x)
            d, _, last = seen.setdefault(unit, (doc_id, i, j))
            if d != doc_id or i > last:
                for k in range(i, j + 1):
                    lines_gone.setdefault(doc_id, {}).setdefault(k, set()).add(seen[unit][:2])
    out = {}
    for doc_id, text in rows:
        gone = [(False, k, k, str(min(v)[0])) for k, v in lines_gone.get(doc_id, {}).items()] + spans.get(doc_id, [])
        out[doc_id] = D.cut(text, gone)
    return out


def test_passages_against_plain_code(spark):
    rng = random.Random(3)
    shared = [[rng.choice(["Alpha", "beta", "gamma", "delta", "x%d" % rng.randint(0, 40)]) for _ in range(n)] for n in (50, 57, 120, 30)] + [[chr(0x4E00 + rng.randint(0, 900)) for _ in range(60)]]
    rows = []
    for i in range(30):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [f"own{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 30))] + rng.choice(shared)
        rows.append((i, "".join(w + rng.choice([" ", " ", "  ", "\n", "\t"]) for w in words)))
    rows += [(30, "one two " * 60), (31, ""), (32, "é " * 19)]
    got = D.dedup(spark.createDataFrame(rows, "doc_id long, text string"), least=50).collect()
    want = whole_rule(rows, 50, D.MIN_WORDS)
    assert {r.doc_id: (r.text, r.removed) for r in got} == {i: (t, ",".join(x)) for i, (t, x) in want.items()}
    assert all(r.n_removed == len([x for x in r.removed.split(",") if x]) for r in got)


def test_every_passage_of_least_words_is_caught(spark):
    """Shared passages of 51 words inside lines, at any place: each later text loses some."""
    rows, rng = [], random.Random(9)
    for i in range(120):
        passage = [f"p{i}w{k}" for k in range(51)]
        for copy in (0, 1):
            own = [f"o{rng.random()}" for _ in range(rng.randint(0, 60))]
            at = rng.randint(0, len(own))
            rows.append((2 * i + copy, " ".join(own[:at] + [w.upper() if copy else w for w in passage] + own[at:])))
    out = {r.doc_id: r for r in D.dedup(spark.createDataFrame(rows, "doc_id long, text string"), least=50).collect()}
    texts = dict(rows)
    for i in range(120):
        assert out[2 * i].n_removed == 0 and out[2 * i].text == texts[2 * i]
        assert out[2 * i + 1].n_removed >= 1 and all(w in out[2 * i + 1].text.split(" ") for w in texts[2 * i + 1].split(" ") if w[0] == "o")


def test_clashing_columns_and_long_text(spark):
    text = " ".join(f"w{i % 9973}" for i in range(300_000))
    rows = [(1, text, 5, "a"), (2, "x " + text, 6, "b"), (None, None, 7, "c")]
    out = D.dedup(spark.createDataFrame(rows, "doc_id long, text string, n_removed int, digest string"), least=50)
    assert out.columns == ["doc_id", "text", "digest", "n_removed", "removed"]
    found = {r.doc_id: r for r in out.collect()}
    assert len(found[1].text) < len(text) and found[2].text.startswith("x ") and len(found[2].text) < 500
    assert found[None].text is None and found[None].n_removed == 0
