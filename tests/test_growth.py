"""Steps that once grew faster than their input, or did less than they should."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mailsieve.functions import text as T
from mailsieve.operators import curation as C
from mailsieve.operators import explain as X
from mailsieve.operators import scoring as SC
from mailsieve.streaming.jobs import late_url_scores


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_runs_are_told_apart_by_hash(spark):
    """Arrays of binaries have no hash sets: every two elements would be compared."""
    rows = [(1, "a b c d e f g a b c d e f"), (2, "x a b c d e f y"), (3, None), (4, " ")]
    df = spark.createDataFrame(rows, "id long, text string")
    assert "array_distinct(transform(sequence" in plan_of(C.word_runs(df, "id")) and "lambdafunction(unhex(md5" not in plan_of(C.word_runs(df, "id"))
    near = C.nearest_copy(df, "id")
    assert "array_intersect(transform(" in plan_of(near)
    runs = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    a, b = runs(rows[0][1]), runs(rows[1][1])
    assert [tuple(r) for r in near.collect()] == [(2, 1, len(a & b) / len(a | b))]


def test_token_weights_meet_as_a_whole(spark):
    rng = random.Random(5)
    mails, weights = [], []
    for i in range(40):
        words = [rng.choice(["Pay", "pay", "##pay", "now", "x1", "é", "Σας", "#"]) + rng.choice(["", "", "!"]) for _ in range(rng.randint(0, 30))]
        mails.append((i, None, " ".join(words)))
        if i % 3:
            weights += [(i, p, rng.choice(["pay", "PAY", "#now", "x1!", "Σας", "other"]), rng.choice([None, 0.1, 0.7, 0.33])) for p in range(rng.randint(0, 9))]
    df = spark.createDataFrame(mails, "email_id long, subject string, text string")
    table = spark.createDataFrame(weights, "email_id long, pos long, token string, score double")
    out = X.attribute_tokens(df, table)
    plan = plan_of(out)
    assert "element_at(_weights" not in plan and "map_zip_with(" in plan
    key = lambda t: t.lower().lstrip("#")
    held = {}
    for i, p, t, s in sorted(weights, key=lambda w: (w[0], w[1])):
        held.setdefault(i, {})[key(t)] = s
    rules = {r.email_id: r.tokens for r in X.with_tokens(df).collect()}
    for r in out.collect():
        assert [(t.pos, t.token) for t in r.tokens] == [(t.pos, t.token) for t in rules[r.email_id]]
        for t, was in zip(r.tokens, rules[r.email_id]):
            want = was.rule
            if r.email_id in held:
                w = held[r.email_id].get(key(t.token))
                want = round((was.rule * 0.5 if w is None else w) * 0.6 + was.rule * 0.4, 4)
            assert t.raw_score == want


def test_late_evidence_meets_by_slices(spark):
    zero, rng = dt.datetime(2026, 1, 1), random.Random(3)
    at = lambda s: zero + dt.timedelta(seconds=s)
    mails = [(i, at(rng.choice([rng.randint(0, 20_000), 3600 * rng.randint(0, 5), 4050 * rng.randint(0, 4)])), 0, rng.choice("ab")) for i in range(150)] + [(900, None, 0, "a"), (901, at(0), 0, None)]
    seen = [(rng.choice("ab"), at(rng.choice([rng.randint(0, 24_000), 3600 * rng.randint(0, 6), 4050 * rng.randint(0, 5)])), i, 0, 1) for i in range(150)] + [("a", None, 7, 0, 1)]
    left = spark.createDataFrame(mails, "email_id int, received_at timestamp, pos int, url string")
    right = spark.createDataFrame(seen, "url string, observed_at timestamp, malicious long, suspicious long, harmless long")
    for within, seconds in (("1 hour", 3600), ("0 seconds", 0), ("90 minutes", 5400), ("1 week", 604_800)):
        out = late_url_scores(left, right, within)
        assert "mail_slice" in plan_of(out)
        want = []
        for i, received, _, url in mails:
            own = [m for u, o, m, *_ in seen if received and o and u == url and received <= o <= received + dt.timedelta(seconds=seconds)]
            want += [(i, m) for m in own] or [(i, None)]
        got = [(r.email_id, r.vt_malicious) for r in out.collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def trained(spark):
    rows = [(i, None if i % 3 else "Hello", f"pay now {i} été", 1) for i in range(20)] + [(20 + i, "", f"meet us {i} 🎉x", 0) for i in range(20)]
    rows += [(50, None, None, 0), (51, "s", "", 1), (52, None, "a ab abc abcd hello-world " + "x" * 97, 0)]
    return spark.createDataFrame(rows, "email_id int, subject string, text string, label int")


def test_fitted_weights_behind_a_batch_function(spark):
    df = trained(spark)
    model = SC.fit_text_model(df)
    both = SC.BatchScorer(SC.portable(model)).score(SC.ModelScorer(model).score(df.drop("label")), out="p_batch").collect()
    assert len(both) == 43 and all(abs(r.p_batch - r.p_phishing) < 1e-9 for r in both)


def test_terms_are_hashed_once_for_fitting(spark):
    """The stages see the written terms, and give what one pipeline over the texts gives."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF

    df, calls = trained(spark), spark.sparkContext.accumulator(0)

    def counted(text):
        calls.add(1)
        return text

    seen = df.withColumn("text", F.udf(counted, "string")("text"))
    model = SC.fit_text_model(seen)
    assert calls.value == df.count()
    rows = df.select(SC.model_tokens(F.col("text"), F.col("subject")).alias("_tokens"), F.col("label").cast("double").alias("label"))
    whole = Pipeline(stages=[
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=1 << 16), IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(featuresCol="_features", maxIter=20, regParam=0.01),
    ]).fit(rows)
    assert abs(model.stages[2].coefficients.toArray() - whole.stages[2].coefficients.toArray()).max() < 1e-9


@pytest.mark.parametrize("name, column", [("fit_and_score_model", "beats_chance"), ("batch_scorer", "agrees")])
def test_models_are_held_against_something(spark, small, name, column):
    rows = entry.queries()[name](spark, small).collect()
    assert rows and all(r[column] for r in rows)


def test_quoted_csv_lies_in_many_files(spark, small):
    out = entry.queries()["read_quoted_csv"](spark, small)
    assert len(out.inputFiles()) > 1


def test_classes_are_the_plain_ones(spark):
    sets = T._SPACE_SET
    plain = {"space": f"[{sets}]", "not_space": f"[^{sets}]", "word": r"[\p{L}\p{N}_]"}
    quick = {"space": T.SPACE, "not_space": T.NOT_SPACE, "word": T.WORD_CHAR}
    points = spark.range(0x110000).filter("id < 55296 OR id > 57343")
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    for flags in ("", "(?i)", "(?iu)"):
        differ = [(F.rlike(char, F.lit(flags + plain[k])) != F.rlike(char, F.lit(flags + quick[k]))).alias(k) for k in plain]
        assert points.select(*differ).filter("space OR not_space OR word").count() == 0


def test_tokens_are_cut_without_a_pattern(spark):
    """Tokens as between any white space; what is inside of a match is looked for in one text."""
    texts = ["verify  your　account: ver -- Act now\tac! click here\nhere", "won w ... on", "plain é words", " ", None]
    df = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "email_id int, subject string, text string")
    out = X.with_tokens(df)
    assert "exists(" not in plan_of(out) and "[!-~[^" not in plan_of(out)
    rules = {r.email_id: [(t.pos, t.token, t.clean, t.rule) for t in r.tokens] for r in out.collect()}
    for i, t in enumerate(texts):
        assert [x[:2] for x in rules[i]] == list(enumerate((t or "").split()))
    assert [x[2:] for x in rules[0]] == [
        ("verify", 0.85), ("your", 0.05), ("account", 0.05), ("ver", 0.75), ("", 0.75), ("act", 0.75), ("now", 0.75), ("ac", 0.75),
        ("click", 0.75), ("here", 0.75), ("here", 0.75),
    ]
    assert [x[2:] for x in rules[1]] == [("won", 0.85), ("w", 0.75), ("", 0.75), ("on", 0.75)]
    assert {x[3] for x in rules[2]} == {0.05}
