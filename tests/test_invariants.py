"""Properties on whole tables and brute-force answers on small ones."""

import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from checks import verdicts as V
from mailsieve.operators import curation as C
from mailsieve.operators import robustness as RO
from mailsieve.operators.authorship import authorship, entropy_by_group
from mailsieve.operators.scoring import RuleScorer
from mailsieve.operators.verdicts import aggregate_risk
from mailsieve.plans.corpus_build import build_corpus
from mailsieve.plans.deep_analysis import deep_analyze, explained
from mailsieve.rules.verdicts import LAYER_FLAG_AT, LAYER_WEIGHTS
from mailsieve.session import small_side
from mailsieve.sources.derived import AS_OF, load_derived, load_table


def test_scores_in_range_and_verdicts_follow(spark, small):
    out = V.deep(spark, small).select("email_id", "combined_risk", "overall_verdict").collect()
    assert len(out) == 200
    for row in out:
        assert 0.0 <= row.combined_risk <= 1.0
        expected = "PHISHING" if row.combined_risk >= 0.65 else "SUSPICIOUS" if row.combined_risk >= 0.30 else "SAFE"
        assert row.overall_verdict == expected


def test_worse_headers_never_lower_the_score(spark, small):
    mails = load_derived(spark, small, "emails").drop("raw_headers")
    bad = "From: PayPal <x@evil.ru>\nAuthentication-Results: m; spf=fail; dkim=fail; dmarc=fail"
    plain = deep_analyze(mails, as_of=AS_OF).select("email_id", "combined_risk")
    worse = deep_analyze(mails.withColumn("raw_headers", F.lit(bad)), as_of=AS_OF)
    both = plain.join(worse.select("email_id", F.col("combined_risk").alias("with_bad")), "email_id")
    # A saturated score meets its own weighted mean; nothing else may drop.
    assert both.filter(F.col("with_bad") < F.col("combined_risk") - 1e-9).count() == 0


def test_layers_without_input_are_absent(spark):
    mails = spark.createDataFrame([(1, "Nothing to see here.")], "email_id long, text string")
    (row,) = deep_analyze(mails, as_of=AS_OF).collect()
    for layer in ("url", "headers", "links", "visual", "crawl", "sender"):
        assert row[f"{layer}_risk"] is None
    assert row.analysis_layers == ["text_classification", "ai_authorship_detection", "xai_explanation"]


def test_all_layer_masks(spark):
    layers = [x for x in LAYER_WEIGHTS if x != "text"]
    rows = []
    for mask in itertools.product([False, True], repeat=len(layers)):
        risks = [round(0.13 * (i + 2), 2) if on else None for i, on in enumerate(mask)]
        rows.append((True, 0.7, False, *risks))
    schema = "is_phishing boolean, confidence double, is_ai_generated boolean, " + ", ".join(
        f"{x}_risk double" for x in layers
    )
    for row in aggregate_risk(spark.createDataFrame(rows, schema)).collect():
        active = {"text": 0.7, **{x: row[f"{x}_risk"] for x in layers if row[f"{x}_risk"] is not None}}
        weight = sum(LAYER_WEIGHTS[x] for x in active)
        mean = sum(v * LAYER_WEIGHTS[x] / weight for x, v in active.items())
        flagged = 1 + sum(active.get(x, 0) >= line for x, line in LAYER_FLAG_AT.items())
        boost = 0.15 if flagged >= 3 else 0.10 if flagged == 2 else 0.0
        assert row.combined_risk == pytest.approx(min(1.0, mean + boost), abs=1e-12)


def test_authorship_against_plain_python(spark):
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in ("kind", "alpha", "mail", "note") for b in ("", "ly", "er", "ing")]
    texts = []
    for i in range(30):
        parts = [
            " ".join(rng.choices(vocabulary, k=rng.randint(1, 14))).capitalize() + rng.choice([".", "!", "?"])
            for _ in range(rng.randint(1, 9))
        ]
        texts.append((i, None, " ".join(parts) + (" Furthermore, act now." if i % 3 else "")))
    df = spark.createDataFrame(texts, "email_id int, subject string, text string")
    out = {r.email_id: r.authorship for r in authorship(df).collect()}
    bits = {r.email_id: r.entropy for r in entropy_by_group(df).collect()}
    for i, _, text in texts:
        tokens = text.lower().replace(".", " ").replace("!", " ").replace("?", " ").replace(",", " ").split()
        n = len(tokens)
        if n < 10:
            assert out[i].ai_authorship_score == 0.0
            continue
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(tokens).values())
        assert bits[i] == pytest.approx(entropy, abs=1e-9)
        assert out[i].perplexity_proxy == pytest.approx(max(0, min(1, (9 - entropy) / 5)), abs=6e-5)
        ttr = len(set(tokens)) / math.sqrt(n)
        assert out[i].vocabulary_richness == pytest.approx(max(0, min(1, (7 - ttr) / 5)), abs=6e-5)
        pairs = list(zip(tokens, tokens[1:]))
        repeated = 1 - len(set(pairs)) / len(pairs)
        assert out[i].repetition_score == pytest.approx(max(0, min(1, repeated / 0.4)), abs=6e-5)


def _key(seed, value):
    return hashlib.md5(f"{seed}:{value}".encode()).hexdigest()


@pytest.fixture(scope="module")
def skewed(spark):
    """One source with a third of all rows, many copies, few rows elsewhere."""
    rows = []
    for i in range(3000):
        source = "hot" if i % 3 == 0 else f"s{i % 40}"
        text = "the same text again" if i % 3 == 0 and i < 1500 else f"text number {i} of many words here"
        rows.append((i, source, int(i % 7 == 0), text))
    return spark.createDataFrame(rows, "id long, source string, label int, text string")


def test_sample_n_against_sorting(skewed):
    rows = skewed.select("id", "source").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.source].append((_key(42, r.id), r.id))
    expected = {i for g in groups.values() for _, i in sorted(g)[:50]}
    assert {r.id for r in C.sample_n(skewed, 50, 42, "id").collect()} == expected


def test_quota_leaves_out_groups_without_quota(spark, skewed):
    quotas = spark.createDataFrame([("hot", 0, 10), ("hot", 1, 3), ("s1", 0, 5)], "source string, label int, quota int")
    out = C.sample_quota(skewed, quotas, 1, "id").groupBy("source", "label").count().collect()
    assert {(r.source, r.label): r["count"] for r in out} == {("hot", 0): 10, ("hot", 1): 3, ("s1", 0): 5}


def test_split_is_exact_disjoint_and_complete(skewed):
    out = C.stratified_split(skewed, 42, "id").collect()
    assert len(out) == 3000 and len({r.id for r in out}) == 3000
    for label in (0, 1):
        ids = sorted((_key(42, r.id), r.id) for r in out if r.label == label)
        n = len(ids)
        place = {i: p for p, (_, i) in enumerate(ids)}
        for r in out:
            if r.label == label:
                p = place[r.id]
                expected = "train" if p < int(0.8 * n) else "validation" if p < int(0.9 * n) else "test"
                assert r.split == expected


def test_tiny_strata_split(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "id long, label int")
    out = {r.id: r.split for r in C.stratified_split(df, 42, "id").collect()}
    assert out[1] == "test" and sorted([out[2], out[3]]) == ["test", "train"]


def test_dedup_exact_keeps_the_first(skewed):
    first = {}
    for r in skewed.orderBy("id").collect():
        first.setdefault(r.text, r.id)
    assert {r.id for r in C.dedup_exact(skewed, ["id"]).collect()} == set(first.values())


def test_overlap_against_brute_force(spark):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 400)}" for _ in range(60)]
    rows = []
    for i in range(120):
        words = list(base) if i % 3 == 0 else [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 40))]
        if i % 3 == 0 and i % 2:
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "id long, text string")
    seen, expected, kept = set(), {}, set()
    for i, text in rows:
        w = text.split()
        runs = {" ".join(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if w else set()
        expected[i] = 1 - len(runs - seen) / len(runs) if runs else 0.0
        seen |= runs
        if expected[i] < 0.8:
            kept.add(i)
    out = {r.id: r.overlap for r in C.shingle_overlap(df, "id").collect()}
    assert out == pytest.approx(expected)
    assert {r.id for r in C.dedup_near(df, "id").collect()} == kept


@pytest.mark.parametrize("most", [1, 40, 1 << 20])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_overlap_over_many_pieces(spark, monkeypatch, most, kind):
    """Rows that are there several times, keys that are NULL, a run in every row, any packing."""
    monkeypatch.setattr(C, "PACKED_RUNS", most)
    rng = random.Random(11)
    rows = []
    for i in range(60):
        words = ["to", "whom", "it", "may", "concern"] + [f"w{rng.randint(0, 12)}" for _ in range(rng.randint(0, 30))]
        rows.append((f"{i:03}" if kind == "string" else i, " ".join(words)))
    rows += [(rows[7][0], rows[7][1]), (rows[7][0], rows[7][1]), (rows[40][0], rows[40][1])]
    rows += [("x" if kind == "string" else 900, None), ("y" if kind == "string" else 901, " ")]
    nobody = [(None, rows[3][1]), (None, "words of nobody that no row has")]
    seen, expected = set(), {}
    for key, text in sorted(set(rows), key=lambda r: r[0]):
        w = (text or "").split()
        runs = {" ".join(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if w else set()
        new = runs - seen
        expected[key] = (len(new), 1 - len(new) / len(runs) if runs else 0.0)
        seen |= runs
    df = spark.createDataFrame(rows + nobody, f"id {kind}, text string").repartition(5, F.rand(3))
    out = [(r.id, r.new_runs, r.overlap) for r in C.shingle_overlap(df, "id").collect()]
    assert sorted(r[0] for r in out if r[0] is not None) == sorted(r[0] for r in rows)
    for key, new, overlap in out:
        assert (new, overlap) == pytest.approx((0, 1.0) if key is None else expected[key])


def test_weights_balance_the_classes(skewed):
    out = C.balance_classes(skewed, 42, "id").groupBy("label").agg(F.sum("weight").alias("w")).collect()
    assert out[0].w == pytest.approx(out[1].w)
    counts = C.balance_classes(skewed, 42, "id", "undersample").groupBy("label").count().collect()
    assert counts[0]["count"] == counts[1]["count"]


def test_small_side_falls_back_to_a_shuffle_join(spark):
    left = spark.range(1000).withColumnRenamed("id", "k")
    few, many = spark.range(10).withColumnRenamed("id", "k"), spark.range(500).withColumnRenamed("id", "k")

    def hinted(df):
        return "broadcast" in left.join(df, "k")._jdf.queryExecution().logical().toString().lower()

    assert hinted(small_side(few, 100)) and not hinted(small_side(many, 100))
    assert left.join(small_side(many, 100), "k").count() == 500


def test_corpus_build(spark, tmp_path):
    def write(name, subject, n):
        lines = ["subject,body,label"]
        for i in range(n):
            label = i % 2
            lines.append(f'{subject} {i},"body of mail {i} which is long enough to be kept in the corpus",{label}')
        lines += lines[1:3]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        return str(tmp_path / name)

    paths = {
        "enron": write("enron.csv", "work", 60), "nazario": write("nazario.csv", "bank", 40),
        "llm_legit": str(tmp_path / "missing.csv"),
    }
    quotas = spark.createDataFrame([("enron", 0, 50), ("nazario", 1, 30)], "source string, label int, quota int")
    out = build_corpus(spark, paths, quotas).collect()
    assert Counter((r.source, r.label, r.email_type) for r in out) == {
        ("enron", 0, "legit"): 50, ("nazario", 1, "phishing"): 30
    }
    assert Counter((r.label, r.split) for r in out) == {
        (0, "train"): 40, (0, "validation"): 5, (0, "test"): 5,
        (1, "train"): 24, (1, "validation"): 3, (1, "test"): 3,
    }
    assert len({r.text for r in out}) == 80


def test_robustness_identities(spark, small):
    mails = load_derived(spark, small, "emails")
    results = RO.robustness(mails, RuleScorer())
    report = RO.robustness_report(results, ["email_id"]).collect()
    for row in report:
        assert row.evasion_rate + row.resilience_score == pytest.approx(1.0)
        assert sum(v.tested for v in row.attack_breakdown.values()) == row.total_tests
        assert sum(v.evaded for v in row.attack_breakdown.values()) == row.evasion_successes
        assert set(row.attack_breakdown) == {"homoglyph", "zero_width", "url_obfuscation", "prompt_evasion"}
    assert results.filter("fooled_by_confidence").count() == 0
    assert results.filter("attack_type = 'zero_width' AND evasion_success").count() == 0


def test_leave_one_out_delta(spark):
    mails = spark.createDataFrame(
        [
            (1, None, "URGENT: verify your account. You won a prize!"),
            (2, None, "see you at lunch"),
            (3, None, "urgent mail to verify that you won"),
        ],
        "email_id long, subject string, text string",
    )
    out = {r.email_id: r for r in explained(mails).collect()}
    assert out[1].is_phishing and out[1].top_tokens[0] == "URGENT:"
    # The token ends in a colon, after which there is no word edge: nothing is removed.
    assert out[1].confidence == 0.55 and out[1].top_token_confidence_delta == 0.0
    assert out[1].summary.startswith("Flagged: flagged because: urgency / time pressure + ")
    assert out[2].summary.startswith("Email appears legitimate")
    assert out[2].top_token_confidence_delta == 0.0
    # Without "urgent" two families are left: .55 phishing turns into .60 legitimate.
    assert out[3].top_tokens[0] == "urgent" and out[3].top_token_confidence_delta == -0.05


def test_hot_url_join_keeps_every_row(spark, small):
    """Every third email shares one URL; the lookup must neither lose nor repeat rows."""
    mails = load_table(spark, small, "documents").select(
        F.col("doc_id").alias("email_id"),
        F.when(F.col("doc_id") % 3 == 0, "see http://hot.example/x")
        .otherwise(F.concat(F.lit("see http://u"), "doc_id", F.lit(".example/")))
        .alias("text"),
    )
    seen = F.lit("2025-12-01T00:00:00Z").cast("timestamp")
    reputation = spark.range(300).select(
        F.lit("http://hot.example/x").alias("url"), F.col("id").alias("malicious"),
        F.lit(0).cast("bigint").alias("suspicious"), F.lit(0).cast("bigint").alias("harmless"),
        seen.alias("observed_at"),
    )
    from mailsieve.plans.deep_analysis import Evidence

    out = deep_analyze(mails, Evidence(reputation=reputation), as_of=AS_OF)
    assert out.count() == 200 and out.select("email_id").distinct().count() == 200
    hot = out.filter(F.col("email_id") % 3 == 0).select("url_risk").distinct().collect()
    assert [r.url_risk for r in hot] == [0.40]
