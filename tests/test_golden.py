"""Hand-derived answers for single emails, URLs, pages and chains."""

import pytest
from pyspark.sql import functions as F

from mailsieve.functions import text as T
from mailsieve.functions import urls as U
from mailsieve.operators import explain as X
from mailsieve.operators import robustness as RO
from mailsieve.operators.authorship import authorship
from mailsieve.operators.curation import clean, min_length, resolve_text, split_valid
from mailsieve.operators.headers import score_headers
from mailsieve.operators.links import link_chains, score_links
from mailsieve.operators.pages import page_features, score_pages
from mailsieve.operators.scoring import classify, classify_four
from mailsieve.operators.senders import score_senders
from mailsieve.operators.urls import score_url_table
from mailsieve.operators.verdicts import aggregate_risk, two_layer_risk
from mailsieve.sources.corpora import read_corpus, repair_lines

AS_OF = "2026-01-01T00:00:00Z"


def one(df):
    (row,) = df.collect()
    return row


@pytest.mark.parametrize(
    "url, domain, score, suspicious",
    [
        ("http://paypal-secure.xyz", "paypal-secure.xyz", 0.50, True),
        ("https://www.google.com", "www.google.com", 0.25, False),
        ("http://secure-banklogin.xyz/verify", "secure-banklogin.xyz", 0.25, False),
        ("http://74.125.224.72/account", "74.125.224.72", 0.55, True),
        ("https://legitimate-site.com@paypal.evil.com", "legitimate-site.com@paypal.evil.com", 0.50, True),
        ("https://%70%61%79%70%61%6c.com/login", "%70%61%79%70%61%6c.com", 0.15, False),
        ("https://netflix.com//login@evil.com", "netflix.com", 0.45, True),
        ("https://microsoft.com.login.attacker.net", "microsoft.com.login.attacker.net", 0.35, True),
        ("https://bit.ly/3xAm4z0n", "bit.ly", 0.0, False),
        ("https://аpple.com", "аpple.com", 0.0, False),
        ("http://www.micros0ft-login.top/a//b", "www.micros0ft-login.top", 0.45, True),
        ("https://a]b.com/x", "unknown", 0.0, True),
        ("https://user:pw@host.com/", "user", 0.15, False),
    ],
)
def test_url_scores(spark, url, domain, score, suspicious):
    row = one(score_url_table(spark.createDataFrame([(url,)], "url string")))
    assert (row.domain, row.risk_score, row.is_suspicious) == (domain, score, suspicious)


def test_strict_brands_spare_own_domains(spark):
    rows = spark.createDataFrame(
        [("https://www.google.com",), ("https://google.com.evil.net",)], "url string"
    )
    scored = {r.url: r for r in score_url_table(rows, strict_brands=True).collect()}
    assert scored["https://www.google.com"].risk_score == 0.0
    assert scored["https://google.com.evil.net"].risk_score == 0.35  # brand and three dots


def test_enrichment_rules(spark):
    url = [("https://new.example/a",), ("https://old.example/a",)]
    seen = "timestamp'2025-12-30 00:00:00Z'"
    registry = spark.sql(
        f"""SELECT 'new.example' AS domain, 'R' AS registrar, timestamp'2025-12-22 12:00:00Z' AS creation_at, {seen} AS observed_at
        UNION ALL SELECT 'new.example', 'late', timestamp'2020-01-01', timestamp'2026-05-01 00:00:00Z'
        UNION ALL SELECT 'old.example', 'R', timestamp'2025-08-01 00:00:00Z', {seen}"""
    )
    tls = spark.sql(
        f"""SELECT 'new.example' AS domain, false AS ssl_valid, CAST(NULL AS string) AS ssl_issuer, CAST(NULL AS timestamp) AS not_after_at, {seen} AS observed_at
        UNION ALL SELECT 'old.example', true, 'I', timestamp'2026-01-03 00:00:00Z', {seen}"""
    )
    reputation = spark.sql(
        f"SELECT 'https://new.example/a' AS url, 10 AS malicious, 2 AS suspicious, 50 AS harmless, {seen} AS observed_at"
    )
    rows = spark.createDataFrame(url, "url string")
    out = {r.url: r for r in score_url_table(rows, registry, tls, reputation, AS_OF).collect()}
    new, old = out["https://new.example/a"], out["https://old.example/a"]
    assert new.flags == [
        "Very new domain (9 days old)", "Invalid SSL certificate",
        "VirusTotal: 10 security vendors flagged as malicious",
        "VirusTotal: 2 vendors flagged as suspicious",
    ]
    assert new.risk_score == 0.75 and new.registrar == "R"
    assert old.flags == [
        "Recently registered domain (153 days old)", "SSL certificate expiring in 2 days"
    ]
    assert old.risk_score == 0.10


def test_extract_urls_order_and_trimming(spark):
    text = (
        "See http://a.com/x). <a class=q href='https://b.com/y '>z</a> www.foo.co.uk/z "
        'https://www.x.org, <img src="/local.png"> <img src="https://c.net/i.png"> http://élan.fr/'
    )
    row = one(spark.createDataFrame([(text,)], "t string").select(U.extract_urls(F.col("t")).alias("u")))
    assert row.u == [
        "https://b.com/y", "https://c.net/i.png", "http://a.com/x", "https://www.x.org",
        "http://élan.fr/", "http://www.foo.co.uk/z", "http://www.x.org",
    ]


def test_cleaning(spark):
    df = spark.createDataFrame(
        [("x\xa0y Â <b>T</b>\r\n www.q.r foo@bar.baz @a.b http://a +1 555 123 4567",), (None,)], "t string"
    )
    rows = df.select(
        T.clean_corpus(F.col("t")).alias("c"), T.clean_inference(F.col("t")).alias("i")
    ).collect()
    assert rows[0].c == "x y T [URL] [EMAIL] @a.b [URL] +1 555 123 4567"
    assert rows[0].i == "x y â <b>t</b> www.q.r [EMAIL] @a.b [URL] +1 [PHONE]"
    assert (rows[1].c, rows[1].i) == ("", "")


def test_words_and_sentences_are_unicode_aware(spark):
    df = spark.createDataFrame([("Café is open. Yes! We do agree, don't we? ok",)], "t string")
    row = one(df.select(T.words(F.col("t")).alias("w"), T.sentences(F.col("t")).alias("s")))
    assert row.w == ["is", "open", "yes", "we", "do", "agree", "don", "we", "ok"]
    assert row.s == ["Café is open.", "We do agree, don't we?"]


BAD = "\n".join(
    [
        "From: PayPal Team <team@paypa1-mail.com>", "Reply-To: box@other.ru",
        "Return-Path: <x@third.xyz>", "Received: from a", "Received: from b", "Received: from c",
        "Authentication-Results: mx; spf=fail;", "\tdkim=fail; dmarc=fail",
        "Date: Mon, 01 Jan 2024 12:00:00 +0000", "", "Received: in the body",
    ]
)
GOOD = "\n".join(
    [
        "From: Forge <bot@forge.com>", "reply-to: bot@forge.com", "Received: from a",
        "Authentication-Results: mx; spf=pass; dkim=pass; dmarc=pass",
        "Date: Wed, 31 Dec 2025 10:00:00 GMT",
    ]
)


def test_headers(spark):
    df = spark.createDataFrame([(1, BAD), (2, GOOD), (3, "  "), (4, None), (5, "")], "id int, raw_headers string")
    out = {r.id: r.headers for r in score_headers(df, AS_OF).collect()}
    bad = out[1]
    assert (bad.spf_result, bad.dkim_result, bad.dmarc_result) == ("fail", "fail", "fail")
    assert bad.reply_to_mismatch and bad.return_path_mismatch and bad.date_anomaly
    assert (bad.received_hops, bad.spoofed_brand, bad.risk_score) == (3, "paypal", 1.0)
    assert bad.date_days_diff == -730
    assert (out[2].risk_score, out[2].flags, out[2].is_suspicious) == (0.0, [], False)
    assert (out[3].flags, out[3].risk_score) == (["No headers provided"], 0.0)
    assert out[4] is None and out[5] is None


@pytest.mark.parametrize(
    "fields, score, suspicious",
    [
        (("PayPal Support", "help@gmail.com", None, "gmail.com", "Standard encryption (TLS)"), 0.45, True),
        (("Ann", "ann@vit.ac.in", "bounce.vit.ac.in", "vit.ac.in", "Standard encryption (TLS)"), 0.0, False),
        ((None, "a@paypa1.com", None, None, None), 0.65, True),
        ((None, "ann@vit.ac.in", None, None, None), 0.25, True),
        (("x", None, None, None, None), 0.0, False),
        (("x", "a@", None, None, None), 0.30, True),
    ],
)
def test_senders(spark, fields, score, suspicious):
    schema = "from_name string, from_email string, mailed_by string, signed_by string, security string"
    row = one(score_senders(spark.createDataFrame([fields], schema)))
    assert (row.sender_check.risk_score, row.sender_check.is_suspicious) == (score, suspicious)


def test_sender_layer_is_absent_without_metadata(spark):
    schema = "from_name string, from_email string, mailed_by string, signed_by string, security string"
    assert one(score_senders(spark.createDataFrame([(None,) * 5], schema))).sender_check is None


def test_short_text_has_no_authorship(spark):
    df = spark.createDataFrame([(None, "too short to say")], "subject string, text string")
    row = one(authorship(df)).authorship
    assert (row.is_ai_generated, row.ai_authorship_score) == (False, 0.0)
    assert row.signals == ["Text too short for reliable AI authorship analysis"]


NONE = dict.fromkeys(["url", "headers", "links", "visual", "crawl", "sender"])


@pytest.mark.parametrize(
    "phishing, confidence, ai, risks, score, verdict",
    [
        (True, 0.95, False, {"url": 0.5}, 0.825, "PHISHING"),
        (True, 0.95, False, {"url": 0.5, "headers": 1.0}, 0.95, "PHISHING"),
        (False, 0.98, False, {}, 0.02, "SAFE"),
        (True, 0.95, True, {"url": 0.5}, 0.905, "PHISHING"),
        (False, 0.98, True, {"url": 0.7}, 0.36, "SUSPICIOUS"),
    ],
)
def test_aggregator(spark, phishing, confidence, ai, risks, score, verdict):
    schema = "is_phishing boolean, confidence double, is_ai_generated boolean, " + ", ".join(
        f"{x}_risk double" for x in NONE
    )
    row = (phishing, confidence, ai, *{**NONE, **risks}.values())
    out = one(aggregate_risk(spark.createDataFrame([row], schema)))
    assert out.overall_risk_score == pytest.approx(score, abs=1e-9)
    assert out.overall_verdict == verdict


def test_two_layers(spark):
    df = spark.createDataFrame(
        [(True, 0.95, 0.5), (False, 0.9, None)], "is_phishing boolean, confidence double, url_risk double"
    )
    rows = two_layer_risk(df).collect()
    assert [(r.overall_risk_score, r.overall_verdict) for r in rows] == [(0.77, "PHISHING"), (0.06, "SAFE")]


def test_risk_levels_and_classes(spark):
    df = spark.createDataFrame([(0.9,), (0.6,), (0.5,), (0.1,)], "p_phishing double")
    rows = classify(df).collect()
    assert [r.risk_level for r in rows] == ["HIGH", "MEDIUM", "LOW", "LOW"]
    assert [r.label for r in rows] == ["PHISHING", "PHISHING", "LEGITIMATE", "LEGITIMATE"]
    four = spark.createDataFrame([([0.1, 0.2, 0.3, 0.4],), ([0.3, 0.3, 0.2, 0.2],)], "probabilities array<double>")
    rows = classify_four(four).collect()
    assert [(r.predicted_class, r.is_phishing) for r in rows] == [
        ("phishing_url_alt", True), ("legitimate_email", False)
    ]


def test_explanation(spark):
    text = "URGENT!! please update your account will be blocked, ver-ify. --"
    df = spark.createDataFrame([(1, "Hi", text)], "email_id int, subject string, text string")
    found = one(X.with_risk_categories(df, T.full_text(F.col("subject"), F.col("text"))))
    assert found.risk_categories == ["urgency", "credential_request", "threat"]
    row = one(X.top_tokens(X.attribute_tokens(df)))
    scores = {t.token: t.score for t in row.tokens}
    assert scores["URGENT!!"] == 1.0 and scores["ver-ify."] == 1.0
    assert scores["account"] == 0.8824 and scores["--"] == 0.8824
    assert row.top_tokens == ["URGENT!!", "blocked,", "ver-ify.", "update", "your", "account", "will"]


def test_nothing_found_highlights_every_word(spark):
    df = spark.createDataFrame([(1, None, "one two three")], "email_id int, subject string, text string")
    row = one(X.attribute_tokens(df))
    assert [(t.raw_score, t.score, t.is_highlighted) for t in row.tokens] == [(0.05, 1.0, True)] * 3


def test_wordpieces(spark):
    rows = [(1, 0, "ver", 0.2), (1, 1, "##ify", 0.9), (1, 2, "now", 0.1), (2, 0, "##x", 0.3)]
    df = spark.createDataFrame(rows, "email_id int, pos int, token string, score double")
    merged = {(r.email_id, r.token): r.score for r in X.merge_wordpieces(df).collect()}
    assert merged == {(1, "verify"): 0.9, (1, "now"): 0.1, (2, "x"): 0.3}


def test_without_token(spark):
    df = spark.createDataFrame([("Act NOW, act  now! (a.c.t) actor", "act"), ("pay (now) ok", "(now)")], "t string, k string")
    rows = df.select(X.without_token(F.col("t"), F.col("k")).alias("r")).collect()
    assert rows[0].r == "NOW, now! (a.c.t) actor"
    assert rows[1].r == "pay (now) ok"


def test_prompt_detector_on_its_own_templates(spark):
    from mailsieve.rules.robustness import EVASION_PHRASES

    df = spark.createDataFrame([(p,) for p in EVASION_PHRASES], "t string")
    rows = df.select(F.size(RO.detect_prompt_phrases(F.col("t"))).alias("n")).collect()
    assert [r.n > 0 for r in rows] == [False, False, True, False, True, True, True, True]


def test_variant_counts(spark):
    rows = [(1, None, "no brand in this text"), (2, None, "PayPal and apple"), (3, None, "short")]
    df = spark.createDataFrame(rows, "email_id int, subject string, text string")
    counts = {r.email_id: r["count"] for r in RO.variants(df).groupBy("email_id").count().collect()}
    assert counts == {1: 20, 2: 22}


def test_page_rules(spark):
    html = (
        "<html><head><title>Log in to PayPal</title></head><body><form action='https://x.ru/p'>"
        "<input type=email name=user><input type='password' name=\"pwd\"></form>"
        "<p>Your wallet: verify your card number</p><script>cvv</script></body></html>"
    )
    schema = "url string, final_url string, status_code int, html string, redirect_chain array<string>, error string"
    rows = [
        ("https://a.com", "https://b.com/login", 200, html, ["1", "2", "3", "4"], None),
        ("https://paypal.com", "https://paypal.com", 200, html, [], None),
        ("https://c.com", "", None, html, [], "failed"),
    ]
    out = {r.url: r for r in score_pages(page_features(spark.createDataFrame(rows, schema))).collect()}
    fake = out["https://a.com"]
    assert fake.input_fields == ["email:user", "password:pwd"] and fake.form_actions == ["https://x.ru/p"]
    assert fake.flags == [
        "Page impersonates Paypal but hosted on b.com",
        "Form submits data to external domain: x.ru",
        "Multiple credential input fields: email:user, password:pwd",
        "Urgency language detected: verify your",
        "Requests sensitive data: card number",
        "Login page title suggests Paypal but domain is b.com",
        "Login page title suggests Facebook but domain is b.com",
        "Login page title suggests Instagram but domain is b.com",
        "Login page title suggests Twitter but domain is b.com",
        "Redirected to different domain: a.com → b.com",
        "Multiple redirects (4 hops)",
    ]
    assert (fake.risk_score, fake.is_fake_login, fake.impersonated_brand) == (1.0, True, "paypal")
    assert out["https://paypal.com"].impersonated_brand is None
    assert out["https://c.com"].risk_score == 0.0 and not out["https://c.com"].has_password_field


def test_link_rules(spark):
    hops = [
        ("https://a.com", 0, "https://a.com", 200, False),
        ("https://b.com", 0, "https://b.com", 301, False), ("https://b.com", 1, "http://b.xyz/", 200, False),
        ("https://bit.ly/x", 0, "https://bit.ly/x", 301, False), ("https://bit.ly/x", 1, "https://bit.ly/y", 200, False),
        ("https://t.com", 0, "https://t.com", None, True),
        ("https://down.com", 0, "https://down.com", None, False),
    ]
    df = spark.createDataFrame(hops, "url string, hop_no int, hop_url string, status int, timed_out boolean")
    out = {r.url: (r.is_suspicious, r.flags) for r in score_links(link_chains(df)).collect()}
    assert out["https://a.com"] == (False, [])
    assert out["https://b.com"] == (
        True,
        [
            "Redirect changes domain: b.com → b.xyz", "Final destination has suspicious TLD: .xyz",
            "Final destination uses insecure HTTP", "Downgraded from HTTPS to HTTP during redirect",
        ],
    )
    assert out["https://bit.ly/x"] == (True, ["URL shortener used: bit.ly"])
    assert out["https://t.com"] == (True, ["Connection timed out (possible malicious server)"])
    assert out["https://down.com"] == (False, [])


def test_csv_repair(spark):
    lines = spark.createDataFrame([("Hello, world,1",), (" x,0 ",), ("no label",), ("",)], "value string")
    rows, rejects = repair_lines(lines)
    assert sorted(tuple(r) for r in rows.collect()) == [("Hello, world", 1), ("x", 0)]
    assert [r.line for r in rejects.collect()] == ["no label"]


def test_corpus_reading(spark, tmp_path):
    long = "word " * 20
    (tmp_path / "ham.csv").write_text(
        f'subject,body,label\nHi,"{long}\nsecond ""line""",0\nSpam,"{long}",1\nHi,short,0\n'
    )
    rows = read_corpus(spark, str(tmp_path / "ham.csv"), "spamassasin").collect()
    assert [(r.text, r.label, r.source, r.email_type) for r in rows] == [
        ("Hi " + long.strip() + ' second "line"', 0, "spamassasin", "legit")
    ]
    assert read_corpus(spark, str(tmp_path / "none.csv"), "nazario").count() == 0


def test_text_columns_and_validation(spark):
    df = spark.createDataFrame([("a", None), (None, "b")], "subject string, body string")
    assert [r.text for r in resolve_text(df).collect()] == ["a ", " b"]
    ok, rejected = split_valid(spark.createDataFrame([("x",), ("",), (None,)], "text string"))
    assert ok.count() == 1 and rejected.count() == 2
    cleaned = min_length(clean(spark.createDataFrame([("<b>" + "x" * 51,), ("x" * 50,)], "text string")))
    assert [len(r.text) for r in cleaned.collect()] == [51]


def test_only_the_first_line_is_the_header(spark, tmp_path):
    from mailsieve.sources.corpora import repair_csv

    (tmp_path / "a.csv").write_text("text,label\nhello, you,1\ntext,label\nx,0\n")
    (tmp_path / "b.csv").write_text("Text,Label\n b,1\n")
    rows, rejects = repair_csv(spark, str(tmp_path))
    assert sorted(map(tuple, rows.collect())) == [("b", 1), ("hello, you", 1), ("x", 0)]
    assert [r.line for r in rejects.collect()] == ["text,label"]


def test_rounding_is_that_of_the_exact_value(spark):
    import random

    from mailsieve.functions.columns import fixed_text, round_to

    rng = random.Random(3)
    values = [i / 100000 for i in range(0, 100001, 5)] + [rng.random() * 3 - 1 for _ in range(20000)]
    values += [k / 2 ** rng.randint(1, 40) for k in range(-2000, 2000)] + [0.605, 0.625, 0.12345, 0.58125, -0.00001]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    x = F.col("x")
    for r in df.select(x, round_to(x, 4).alias("a"), fixed_text(x, 2).alias("b"), fixed_text(x * 100, 1).alias("c")).collect():
        assert repr(round(r.x, 4)) == repr(r.a) and f"{r.x:.2f}" == r.b and f"{r.x:.1%}" == r.c + "%"


def test_term_model_against_plain_python(spark):
    import math

    from mailsieve.operators.scoring import TermScorer, fit_term_model

    rows = [(1, "pay now pay", 1), (2, "pay today", 1), (3, "meet today", 0), (4, "meet us now", 0), (5, None, 0), (6, "rare", 1), (7, "x now", None)]
    df = spark.createDataFrame(rows, "email_id long, text string, label int")
    model = fit_term_model(df)
    held = {}
    for _, text, label in rows:
        for term in set((text or "").split()) if label is not None else ():
            held.setdefault(term, [0, 0])[label] += 1
    weight = {
        t: math.floor(1e6 * (math.log((n[1] + 1) / 5) - math.log((n[0] + 1) / 5)) + 0.5) for t, n in held.items() if sum(n) >= 2
    }
    assert {r.term: r.weight for r in model.weights.collect()} == weight and set(weight) == {"pay", "now", "today", "meet"}
    assert model.prior == 0
    got = {r.email_id: r.p_phishing for r in TermScorer(model).score(df, subject=None).collect()}
    for i, text, _ in rows:
        logit = sum(weight.get(t, 0) for t in set((text or "").split())) / 1e6
        assert abs(got[i] - 1 / (1 + math.exp(-logit))) < 1e-12
    none = fit_term_model(df.limit(0))
    assert none.weights.count() == 0 and {r.p_phishing for r in TermScorer(none).score(df, subject=None).collect()} == {0.5}


def test_fitted_pipeline_ranks_its_training_rows(spark):
    from mailsieve.operators.scoring import ModelScorer, fit_text_model

    rows = [(f"pay now {i}", 1) for i in range(20)] + [(f"meet us {i}", 0) for i in range(20)]
    df = spark.createDataFrame(rows, "text string, label int")
    scored = ModelScorer(fit_text_model(df)).score(df.withColumnRenamed("label", "truth"), subject=None).collect()
    assert min(r.p_phishing for r in scored if r.truth) > max(r.p_phishing for r in scored if not r.truth)


def test_corpus_keeps_one_of_each_text(spark, tmp_path):
    from mailsieve.plans.corpus_build import build_corpus

    long = "some words that make a text long enough to stay in the corpus number "
    (tmp_path / "n.csv").write_text("subject,body\n" + "".join(f"s,{long}{i % 5}\n" for i in range(20)))
    (tmp_path / "f.csv").write_text("subject,body\n" + "".join(f"s,{long}{i % 9}\n" for i in range(20)))
    paths = {"nazario": str(tmp_path / "n.csv"), "nigerian_fraud": str(tmp_path / "f.csv")}
    rows = build_corpus(spark, paths).collect()
    assert sorted((r.source, r.text[-1]) for r in rows) == [("nazario", str(i)) for i in range(5)] + [("nigerian_fraud", str(i)) for i in range(5, 9)]


def test_log_batches(spark, tmp_path):
    import datetime as dt

    from mailsieve.sources import sinks

    start, path = dt.datetime(2026, 1, 1), str(tmp_path / "log")
    times = {b: [start + dt.timedelta(days=b, minutes=i) for i in range(4)] for b in range(15)}
    for b in [*range(15), 7, 14]:
        rows = [(b * 10 + i, t) for i, t in enumerate(times[b])]
        sinks.append_log(spark.createDataFrame(rows, "email_id long, at timestamp"), path, b)
    sinks.append_log(spark.createDataFrame([], "email_id long, at timestamp"), path, 15)
    every = sorted(((t, b * 10 + i) for b in times for i, t in enumerate(times[b])), reverse=True)
    assert sinks.read_log(spark, path).count() == 60
    for n in (1, 5, 10, 100):
        found = sinks.latest(spark, path, n)
        assert [(r.at, r.email_id) for r in found.collect()] == every[:n]
    # A batch whose index row is missing was not committed.
    spark.createDataFrame([(999, start)], "email_id long, at timestamp").write.parquet(f"{path}/entries/batch=99")
    assert sinks.read_log(spark, path).count() == 60 and 999 not in {r.email_id for r in sinks.latest(spark, path, 100).collect()}


def test_newest_before_against_all_pairs(spark):
    import datetime as dt
    import random

    from mailsieve.operators.asof import newest_before

    rng, start = random.Random(6), dt.datetime(2026, 1, 1)
    when = lambda: start + dt.timedelta(hours=rng.randrange(24 * 40))
    facts = [(rng.choice(["a", "a", "b", None]), rng.choice([when(), when(), None]), rng.randrange(9)) for _ in range(150)]
    facts += [("a", start + dt.timedelta(days=7), v) for v in (3, 8, 5)]
    rows = [(i, rng.choice(["a", "a", "a", "b", "none", None]), rng.choice([when(), when(), when(), None])) for i in range(300)]
    rows += [(300, "a", start + dt.timedelta(days=7)), (300, "a", start + dt.timedelta(days=7)), (301, "b", start - dt.timedelta(days=1))]
    df = spark.createDataFrame(rows, "i int, domain string, at timestamp")
    known = spark.createDataFrame(facts, "domain string, observed_at timestamp, v int")
    want = sorted((i, max([(t, v) for k, t, v in facts if key and k == key and t and at and t <= at] or [()])) for i, key, at in rows)
    for seconds in (3600, 7 * 86400, 10**9):
        got = newest_before(df, known, "domain", "at", slice_seconds=seconds).collect()
        assert sorted((r.i, tuple(r.fact) if r.fact else ()) for r in got) == want
    assert newest_before(df, known.limit(0), "domain", "at").filter("fact IS NULL").count() == len(rows)
    assert newest_before(df.limit(0), known, "domain", "at").count() == 0
