"""Quality rules against plain code, and the ledger's policies and ablations."""

from collections import Counter

from pyspark.sql import functions as F

from mailsieve.llm import quality_rules as R
from tests.llm.brute import words

TEXTS = [
    None, "", " \t\n ", "one", "a b c a b c a b c", "x y\nx y\n\n x y\nz", "ÄÖÜ ß # * 🎉🎉 || <b>", "a a a a a", "a b\x0bc\x0cd\re",
    "the cat sat on the mat " * 30, "long " * 3000 + "tail", "UPPER CASE " * 40,
]


def plain(text):
    w = words(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    joined = "".join(w)
    return (
        len(w), len(joined), sum(c in R.SYMBOLS for c in joined), len(lines) - len(set(lines)), len(covered), len(lines)
    )


def test_measures(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    out = R.measure(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines) for r in out}
    assert got == {i: plain(t) for i, t in rows}


def test_clashing_names_ties_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", 7, "x", 0), (1, "a b", 7, "x", 0)], "doc_id long, text string, n_words int, row string, fail_bits int")
    out = R.ledger(df)
    assert out.count() == 2 and out.schema["n_words"].dataType.simpleString() == "bigint"
    assert R.keep(df).columns == df.columns and R.keep(df).count() == 0
    assert R.ledger(df.limit(0)).count() == 0


def test_ablation_is_bit_arithmetic(spark):
    rows = [(0,), (1,), (2,), (3,), (17,), (16,)]
    df = spark.createDataFrame(rows, "fail_bits long")
    policy = R.Policy("p", 2, ("few_words", "repeated_words", "symbols"))
    got = {r.rule: r[1:] for r in R.ablation(df, policy).collect()}
    assert got == {"few_words": (3, 1, 2), "repeated_words": (2, 1, 2), "symbols": (2, 1, 2)}


def test_policies_read_the_same_ledger(spark):
    text = "word " * 20
    df = R.ledger(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert df.filter(R.failed(R.BASE)).count() == 1
    assert df.filter(R.failed(R.Policy("none", 1, ("symbols",)))).count() == 0


def test_keep_keeps_clean_rows_whole(spark):
    clean = "\n".join(" ".join(f"plain{chr(97 + i)}{chr(97 + k)}" for k in range(8)) for i in range(12))
    df = spark.createDataFrame([(1, clean, None), (2, "###" * 90, "x")], "doc_id long, text string, lang string")
    assert [tuple(r) for r in R.keep(df).collect()] == [(1, clean, None)]
    assert R.keep(df).agg(F.sum("doc_id")).first()[0] == 1
