"""Queries and check SQL: classifier, evaluation, verdicts, ablation, robustness, log."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.curation import CORPUS, INFER, corpus, emails
from checks.duck import EMAIL_URLS, NS, NW, PARSED, S, compact, ctes, first_in, hits, joined, lst, q, round_even, rx, strip
from checks.mail import CATS, SCORED_HEADERS, SCORED_SENDERS, TOKENS, authored, scored_tokens
from checks.urls import (
    CHAINS,
    ENRICHED,
    FACTS,
    FEATURES,
    LINK_AGG,
    LINK_SCORE,
    PAGE_AGG,
    PAGE_FACTS,
    SCORED_LINKS,
    SCORED_PAGES,
    bar,
    scored_urls,
)
from mailsieve.functions.columns import round_to
from mailsieve.operators import evaluation as E
from mailsieve.operators import robustness as RO
from mailsieve.operators import scoring as SC
from mailsieve.operators import verdicts as V
from mailsieve.operators.authorship import authorship
from mailsieve.operators.curation import stratified_split
from mailsieve.plans.deep_analysis import Evidence, analyzed_layers, deep_analyze, explained, full_analyze
from mailsieve.rules import robustness as RR
from mailsieve.rules import verdicts as VR
from mailsieve.rules import explain as XR
from mailsieve.session import shared_dir, written
from mailsieve.sources import sinks
from mailsieve.sources.derived import AS_OF, load_derived, load_table

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


MAILS = ctes("emails")
_P = "least(100, 10 + 15 * len(risk_categories))::DOUBLE / 100.0::DOUBLE"
SCORES = f"""{CATS}, pr AS (SELECT email_id, {_P} AS p FROM cats),
  cl AS (SELECT email_id, p, p > 0.5::DOUBLE AS is_phishing, CASE WHEN p > 0.5::DOUBLE THEN p ELSE 1.0::DOUBLE - p END AS confidence FROM pr)"""
_RISK = "CASE WHEN is_phishing AND confidence >= 0.85::DOUBLE THEN 'HIGH' WHEN is_phishing AND confidence >= 0.5::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END"


def classified(spark, sf):
    return SC.classify(SC.RuleScorer().score(emails(spark, sf)))


@query(
    "classify",
    f"""{MAILS}, {SCORES} SELECT email_id, p AS p_phishing, is_phishing, confidence,
    CASE WHEN is_phishing THEN 'PHISHING' ELSE 'LEGITIMATE' END AS label, {_RISK} AS risk_level FROM cl""",
)
def _classify(spark, sf):
    return classified(spark, sf).select(
        "email_id", "p_phishing", "is_phishing", "confidence", "label", "risk_level"
    )


# Class probabilities made from the vectors: the share of every fourth component's squares.
_SQUARES = "list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))"
_SUMS = ", ".join(
    f"list_reduce(list_filter({_SQUARES}, lambda x, i: i % 4 = {(k + 1) % 4}), lambda a, x: a + x, 0.0::DOUBLE)" for k in range(4)
)


@query(
    "classify_four",
    f"""WITH e AS (SELECT vec_id, [{_SUMS}] AS s FROM embeddings),
    p AS (SELECT vec_id, list_transform(s, lambda x: x / (s[1] + s[2] + s[3] + s[4])) AS pr FROM e),
    b AS (SELECT vec_id, list_position(pr, list_max(pr)) - 1 AS k, list_max(pr) AS confidence FROM p), c AS (SELECT *, k IN (1, 3) AS is_phishing FROM b)
    SELECT vec_id, {lst(VR.CLASS_NAMES)}[k + 1] AS predicted_class, is_phishing, confidence, {_RISK} AS risk_level FROM c""",
)
def _classify_four(spark, sf):
    squares = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))

    def every_fourth(k: int) -> F.Column:
        return F.aggregate(F.filter(squares, lambda x, i: i % 4 == k), F.lit(0.0), lambda a, x: a + x)

    sums = [every_fourth(k) for k in range(4)]
    rows = load_table(spark, sf, "embeddings").select("vec_id", F.array(*sums).alias("s"))
    s = F.col("s")
    total = s[0] + s[1] + s[2] + s[3]
    rows = rows.select("vec_id", F.transform(s, lambda x: x / total).alias("probabilities"))
    out = SC.classify_four(rows)
    return out.select("vec_id", "predicted_class", "is_phishing", "confidence", "risk_level")


@query(
    "batch_summary",
    f"{MAILS}, {SCORES} SELECT count(*) AS total, count(*) FILTER (WHERE is_phishing) AS phishing_count, count(*) FILTER (WHERE NOT is_phishing) AS legitimate_count FROM cl",
)
def _batch(spark, sf):
    return SC.batch_summary(classified(spark, sf))


_COMBINED = "CASE WHEN coalesce(subject, '') <> '' THEN 'Subject: ' || subject || chr(10) || chr(10) || text ELSE text END"


@query(
    "model_tokens",
    f"""{MAILS}, t AS (SELECT email_id, regexp_extract_all({INFER % _COMBINED}, '{NS}+') AS w FROM emails)
    SELECT email_id, CAST(len(w) AS INTEGER) AS n_tokens, md5(array_to_string(w, ' ')) AS tokens_md5 FROM t""",
)
def _tokens(spark, sf):
    rows = emails(spark, sf).select("email_id", SC.model_tokens(F.col("text"), F.col("subject")).alias("w"))
    return rows.select("email_id", F.size("w").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("tokens_md5"))


LABELLED_SPLIT = f"""{MAILS}, lm AS (SELECT e.email_id, CAST(l.toxic AS INTEGER) AS label FROM emails e JOIN labels l ON l.doc_id = e.email_id),
  n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || email_id)) AS rn, count(*) OVER (PARTITION BY label) AS n FROM lm),
  sp AS (SELECT *, CASE WHEN rn <= floor(0.8::DOUBLE * n) THEN 'train' WHEN rn <= floor(0.9::DOUBLE * n) THEN 'validation' ELSE 'test' END AS split FROM n)"""


def labelled_split(spark, sf):
    """Labelled emails with their split, written once: fitting reads them again and again."""
    mails = emails(spark, sf).select("email_id", "subject", "text")
    labels = load_table(spark, sf, "labels").select(F.col("doc_id").alias("email_id"), F.col("toxic").cast("int").alias("label"))
    return written(stratified_split(E.join_labels(mails, labels, "email_id"), 42, "email_id"), "labelled")


def fitted(spark, sf):
    rows = labelled_split(spark, sf)
    return SC.fit_text_model(rows.filter(F.col("split") == "train")), rows


@query(
    "fit_and_score_model",
    f"""{LABELLED_SPLIT} SELECT split, label, count(*) AS emails, count(*) AS scored, TRUE AS beats_chance FROM sp GROUP BY split, label""",
)
def _model(spark, sf):
    """A model fitted on the training split: rows per split and label, how many it scores
    between 0 and 1, and whether it ranks its training rows better than chance."""
    model, rows = fitted(spark, sf)
    scored = SC.ModelScorer(model).score(rows.withColumnRenamed("label", "truth"))
    counted = scored.groupBy("split", F.col("truth").alias("label")).agg(
        F.count(F.lit(1)).alias("emails"),
        F.count_if(F.col("p_phishing").between(0, 1)).alias("scored"),
        F.avg("p_phishing").alias("p"),
    )

    def trained(label: int):  # over a row per split and label
        own = (F.col("split") == "train") & (F.col("label") == label)
        return F.max(F.when(own, F.col("p"))).over(Window.partitionBy(F.lit(1)))

    return counted.withColumn("beats_chance", trained(1) > trained(0)).drop("p")


TERM_WEIGHTS = f"""{LABELLED_SPLIT}, tk AS (SELECT email_id, label, split, unnest(list_distinct(regexp_extract_all({INFER % _COMBINED}, '{NS}+'))) AS term FROM sp JOIN emails USING (email_id)),
  tn AS (SELECT count(*) FILTER (WHERE label = 1) AS ones, count(*) FILTER (WHERE label = 0) AS zeros FROM sp WHERE split = 'train'),
  tc AS (SELECT term, count(*) FILTER (WHERE label = 1) AS with_1, count(*) FILTER (WHERE label = 0) AS with_0 FROM tk WHERE split = 'train' GROUP BY term HAVING count(*) >= 2),
  tw AS (SELECT term, with_1, with_0, CAST(floor(1000000::DOUBLE * (ln((with_1 + 1)::DOUBLE / (ones + 2)::DOUBLE) - ln((with_0 + 1)::DOUBLE / (zeros + 2)::DOUBLE)) + 0.5::DOUBLE) AS BIGINT) AS weight FROM tc, tn),
  tp AS (SELECT CAST(floor(1000000::DOUBLE * ln((ones + 1)::DOUBLE / (zeros + 1)::DOUBLE) + 0.5::DOUBLE) AS BIGINT) AS prior FROM tn)"""


def term_model(spark, sf):
    rows = labelled_split(spark, sf)
    return SC.fit_term_model(rows.filter(F.col("split") == "train")), rows


@query("term_weights", f"{TERM_WEIGHTS} SELECT term, with_1, with_0, weight FROM tw")
def _term_weights(spark, sf):
    """The weights of a model fitted on the training split."""
    return term_model(spark, sf)[0].weights


@query(
    "term_scores",
    f"""{TERM_WEIGHTS}, ts AS (SELECT email_id, sum(weight) AS w FROM tk JOIN tw USING (term) GROUP BY email_id),
  tl AS (SELECT email_id, sp.label, split, greatest(-30::DOUBLE, least(30::DOUBLE, (coalesce(w + prior, prior))::DOUBLE / 1000000::DOUBLE)) AS z FROM sp LEFT JOIN ts USING (email_id), tp)
  SELECT email_id, label, split, CAST(floor(1000000::DOUBLE / (1::DOUBLE + exp(-z)) + 0.5::DOUBLE) AS BIGINT) AS p_millionths FROM tl""",
)
def _term_scores(spark, sf):
    """The probability of every labelled mail by that model, in millionths."""
    model, rows = term_model(spark, sf)
    scored = SC.TermScorer(model).score(rows)
    return scored.select("email_id", "label", "split", F.floor(F.col("p_phishing") * 1_000_000 + 0.5).alias("p_millionths"))


def _placeholder_share():
    """A model from outside: ten percent per link or address in the cleaned text."""
    return lambda texts: (texts.str.count(r"\[URL\]|\[EMAIL\]") * 10).clip(upper=100) / 100.0


@query(
    "batch_scorer",
    f"""{MAILS}, c AS (SELECT email_id, len(regexp_extract_all({INFER % _COMBINED}, '\\[URL\\]|\\[EMAIL\\]')) AS n FROM emails)
    SELECT email_id, least(100, n * 10)::DOUBLE / 100::DOUBLE AS p_phishing, TRUE AS agrees FROM c""",
)
def _udf(spark, sf):
    """Two models behind an Arrow batch function, loaded once per task: one from outside, and
    the fitted weights, held against the pipeline row by row."""
    model, _ = fitted(spark, sf)
    mails = emails(spark, sf).select("email_id", "subject", "text")
    outside = SC.BatchScorer(_placeholder_share).score(mails, out="p_outside")
    # The pipeline takes a missing text as empty.
    known = SC.ModelScorer(model).score(outside).withColumn("text", F.coalesce("text", F.lit("")))
    both = SC.BatchScorer(SC.portable(model)).score(known, out="p_batch")
    agrees = F.abs(F.col("p_batch") - F.col("p_phishing")) < 1e-9
    return both.select("email_id", F.col("p_outside").alias("p_phishing"), agrees.alias("agrees"))


# Evaluation: rule prediction on emails against the labels of their documents.
PRED = f"""{SCORES}, ev AS (SELECT c.email_id, e.source, CAST(c.is_phishing AS INTEGER) AS pred, CAST(l.toxic AS INTEGER) AS label
  FROM cl c JOIN emails e USING (email_id) JOIN labels l ON l.doc_id = c.email_id)"""


def predictions(spark, sf):
    labels = load_table(spark, sf, "labels").select(
        F.col("doc_id").alias("email_id"), F.col("toxic").cast("int").alias("truth")
    )
    preds = classified(spark, sf).select("email_id", "source", F.col("is_phishing").cast("int").alias("pred"))
    return E.join_labels(preds, labels, "email_id").withColumnRenamed("truth", "label")


@query("join_labels", f"{MAILS}, {PRED} SELECT email_id, source, pred, label FROM ev")
def _join_labels(spark, sf):
    return predictions(spark, sf)


_CELLS = """count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
  count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp"""


def _metrics_sql(source: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {keys}tn + fp + fn + tp AS n, coalesce((tp + tn) / (tn + fp + fn + tp), 0.0::DOUBLE) AS accuracy,
    CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fn) END AS recall,
    CASE WHEN tp * 2 + fp + fn = 0 THEN 0.0::DOUBLE ELSE tp * 2 / (tp * 2 + fp + fn) END AS f1 FROM (SELECT {keys}{_CELLS} FROM {source} {group})"""


@query("metrics", f"{MAILS}, {PRED} {_metrics_sql('ev')}")
def _metrics(spark, sf):
    return E.metrics(predictions(spark, sf))


@query("metrics_by_source", f"{MAILS}, {PRED} {_metrics_sql('ev', 'source')}")
def _metrics_by(spark, sf):
    return E.metrics(predictions(spark, sf), by=["source"])


@query("confusion", f"{MAILS}, {PRED} SELECT {_CELLS} FROM ev")
def _confusion(spark, sf):
    return E.confusion(predictions(spark, sf))


_ACC = "count(*) FILTER (WHERE label = pred) / count(*) AS accuracy, count(*) AS samples"


@query("accuracy_by_source", f"{MAILS}, {PRED} SELECT source, {_ACC} FROM ev GROUP BY source")
def _by_source(spark, sf):
    return E.accuracy_by_source(predictions(spark, sf))


@query("accuracy_by_source_label", f"{MAILS}, {PRED} SELECT source, label, {_ACC} FROM ev GROUP BY source, label")
def _by_both(spark, sf):
    return E.accuracy_by_source_label(predictions(spark, sf))


@query("accuracy_cube", f"{MAILS}, {PRED} SELECT source, label, {_ACC} FROM ev GROUP BY CUBE (source, label)")
def _cube(spark, sf):
    return E.accuracy_by_source_label(predictions(spark, sf), totals=True)


@query(
    "authorship_metrics",
    f"""WITH docs AS (SELECT doc_id AS email_id, NULL::VARCHAR AS subject, text FROM documents), {authored("docs")},
    o AS (SELECT CAST(l.quality = 0 AS INTEGER) AS label, CAST(is_ai_generated AS INTEGER) AS pred FROM authorship a JOIN labels l ON l.doc_id = a.email_id) {_metrics_sql("o")}""",
)
def _authorship_metrics(spark, sf):
    """Documents labelled as of low quality stand for the machine-written ones."""
    origin = F.when(F.col("quality") == 0, "llm").otherwise("human")
    labels = load_table(spark, sf, "labels").select("doc_id", origin.alias("origin"))
    docs = load_table(spark, sf, "documents").join(labels, "doc_id").select(
        F.col("doc_id").alias("email_id"), F.lit(None).cast("string").alias("subject"), "text",
        F.col("origin").alias("source"),
    )
    out = authorship(docs).select("source", "authorship.is_ai_generated")
    return E.authorship_metrics(out)


# Verdicts
LAYERS = list(VR.LAYER_WEIGHTS)


def verdict_sql(active=LAYERS, ai: bool = True, boost: bool = True, source: str = "lay") -> str:
    """Relation with weighted, flagging, combined and verdict for a relation of layer risks."""
    total = " + ".join(f"CASE WHEN {x}_risk IS NOT NULL THEN {VR.LAYER_WEIGHTS[x]}::DOUBLE ELSE 0.0::DOUBLE END" for x in active)
    mean = " + ".join(
        f"CASE WHEN {x}_risk IS NOT NULL THEN {x}_risk * ({VR.LAYER_WEIGHTS[x]}::DOUBLE / tw) ELSE 0.0::DOUBLE END" for x in active
    )
    flag = " + ".join(
        ["is_phishing::INTEGER"]
        + [f"coalesce(({x}_risk >= {line}::DOUBLE)::INTEGER, 0)" for x, line in VR.LAYER_FLAG_AT.items() if x in active]
    )
    a = "CASE WHEN is_ai_generated AND is_phishing THEN least(1.0::DOUBLE, weighted + 0.08::DOUBLE) ELSE weighted END" if ai else "weighted"
    b = "CASE WHEN flagging >= 3 THEN least(1.0::DOUBLE, r + 0.15::DOUBLE) WHEN flagging >= 2 THEN least(1.0::DOUBLE, r + 0.10::DOUBLE) ELSE r END" if boost else "r"
    return f"""(SELECT *, CASE WHEN combined >= 0.65::DOUBLE THEN 'PHISHING' WHEN combined >= 0.30::DOUBLE THEN 'SUSPICIOUS' ELSE 'SAFE' END AS verdict
      FROM (SELECT *, {b} AS combined FROM (SELECT *, {a} AS r FROM (SELECT *, 0.0::DOUBLE + {mean} AS weighted, {flag} AS flagging
        FROM (SELECT *, 0.0::DOUBLE + {total} AS tw FROM {source})))))"""


ALL = ctes("emails", "crawled_pages", "domain_registry", "tls_observations", "url_reputation", "link_hops")
LAYER_CTES = f"""{ALL}, {PARSED}, {EMAIL_URLS}, {SCORES}, {SCORED_HEADERS}, {SCORED_SENDERS}, {authored("emails")},
  {FACTS}, {ENRICHED}, uf AS (SELECT * FROM {scored_urls("SELECT * FROM enriched")}),
  ur AS (SELECT email_id, count(*) AS total_urls, count(*) FILTER (WHERE is_suspicious) AS suspicious_count, max(risk_score) AS url_risk,
    coalesce(flatten(list(flags ORDER BY pos) FILTER (WHERE is_suspicious)), []::VARCHAR[]) AS url_factors FROM uf GROUP BY email_id),
  {FEATURES}, {SCORED_PAGES}, {PAGE_FACTS},
  seen AS (SELECT e.email_id, e.pos, e.take_screenshots, e.take_screenshots AND f.error IS NULL AS shown, f.* EXCLUDE (url, page_id)
    FROM email_urls e JOIN page_facts f ON e.url = f.url WHERE e.crawl_urls),
  pg AS (SELECT email_id, {PAGE_AGG} FROM seen GROUP BY email_id),
  {CHAINS}, {SCORED_LINKS}, la AS (SELECT email_id, {LINK_AGG} FROM email_urls e LEFT JOIN links l ON e.url = l.url WHERE first_seen GROUP BY email_id),
  lay AS (SELECT c.email_id, c.is_phishing, c.confidence, CASE WHEN c.is_phishing THEN c.confidence ELSE 1.0::DOUBLE - c.confidence END AS text_risk,
    u.url_risk, h.risk_score AS headers_risk, CASE WHEN checked_links IS NOT NULL THEN {LINK_SCORE} END AS links_risk, g.visual_risk, g.crawl_risk, s.risk_score AS sender_risk,
    a.is_ai_generated, a.ai_authorship_score, u.total_urls, u.url_factors, g.visual_factors, g.crawl_factors, l.suspicious_links, l.link_flags,
    s.flags AS sender_flags, s.is_suspicious AS sender_suspicious, h.flags AS header_flags, h.is_suspicious AS header_suspicious
    FROM cl c LEFT JOIN ur u USING (email_id) LEFT JOIN headers h USING (email_id) LEFT JOIN la l USING (email_id) LEFT JOIN pg g USING (email_id)
    LEFT JOIN senders s USING (email_id) LEFT JOIN authorship a USING (email_id))"""


def evidence(spark, sf) -> Evidence:
    names = ("domain_registry", "tls_observations", "url_reputation", "crawled_pages", "link_hops")
    return Evidence(*[load_derived(spark, sf, n) for n in names])


def deep(spark, sf):
    return deep_analyze(emails(spark, sf), evidence(spark, sf), as_of=AS_OF)


@query("verdicts", f"{LAYER_CTES} SELECT verdict AS overall_verdict, count(*) AS emails FROM {verdict_sql()} GROUP BY verdict")
def _verdicts(spark, sf):
    return deep(spark, sf).groupBy("overall_verdict").agg(F.count(F.lit(1)).alias("emails"))


@query(
    "layer_risks",
    f"{LAYER_CTES} SELECT email_id, text_risk, url_risk, headers_risk, links_risk, visual_risk, crawl_risk, sender_risk, is_ai_generated FROM lay",
)
def _layer_risks(spark, sf):
    out = analyzed_layers(emails(spark, sf), evidence(spark, sf), as_of=AS_OF)
    return out.withColumn("text_risk", V.text_risk()).select(
        "email_id", *[f"{x}_risk" for x in LAYERS], "is_ai_generated"
    )


@query(
    "deep_analyze",
    f"""{LAYER_CTES} SELECT email_id, {round_even('combined')} AS overall_risk_score, verdict AS overall_verdict, flagging AS flagging_layers,
    coalesce(array_to_string(list_distinct_keep, '|'), '') AS risk_factors FROM (SELECT *, list_transform(list_filter(list_transform(fs, lambda x, i: {{'x': x, 'i': i, 'p': list_position(fs, x)}}), lambda s: s.i = s.p), lambda s: s.x) AS list_distinct_keep
    FROM (SELECT *, list_filter(list_concat(list_concat(list_concat(
      CASE WHEN is_phishing THEN ['Email text classified as phishing (' || printf('%.1f', confidence * 100) || '% confidence)'] ELSE [] END,
      CASE WHEN sender_suspicious THEN sender_flags ELSE [] END), list_concat(coalesce(url_factors, []), string_split(coalesce(visual_factors, ''), '|'))),
      list_concat(list_concat(string_split(coalesce(crawl_factors, ''), '|'),
      CASE WHEN is_ai_generated THEN ['Email text likely AI-generated (score: ' || CAST(round_even(ai_authorship_score * 100, 0) AS INTEGER) || '%)'] ELSE [] END),
      list_concat(CASE WHEN suspicious_links > 0 THEN link_flags ELSE [] END, CASE WHEN header_suspicious THEN header_flags ELSE [] END))), lambda z: z <> '') AS fs
    FROM {verdict_sql()}))""",
)
def _deep(spark, sf):
    out = deep(spark, sf)
    return out.select(
        "email_id", "overall_risk_score", "overall_verdict", "flagging_layers",
        bar("risk_factors").alias("risk_factors"),
    )


@query(
    "deep_details",
    f"""{LAYER_CTES} SELECT 'url' AS kind, email_id, pos AS pos, url, is_suspicious AS hit, risk_score AS risk, {joined("flags")} AS flags FROM uf
    UNION ALL SELECT 'crawl', email_id, pos, (SELECT any_value(u.url) FROM email_urls u WHERE u.email_id = seen.email_id AND u.pos = seen.pos), has_password_field, NULL, coalesce(error, '') FROM seen
    UNION ALL SELECT 'visual', email_id, pos, (SELECT any_value(u.url) FROM email_urls u WHERE u.email_id = seen.email_id AND u.pos = seen.pos), is_fake_login, risk_score, {joined("flags")} FROM seen WHERE shown""",
)
def _details(spark, sf):
    """Results per URL, crawled page and page shown, one row each."""
    out = deep_analyze(emails(spark, sf), evidence(spark, sf), as_of=AS_OF, explaining=False, details=True)
    out = written(out.select("email_id", "url_results", "crawl_results", "visual_results"), "details")
    none = F.lit(None).cast("double")
    kinds = [
        ("url", "url_results", F.col("is_suspicious"), F.col("risk_score"), bar("flags")),
        ("crawl", "crawl_results", F.col("has_password_field"), none, F.coalesce("error", F.lit(""))),
        ("visual", "visual_results", F.col("is_fake_login"), F.col("visual_risk"), bar("visual_flags")),
    ]
    frames = []
    for kind, column, hit, risk, flags in kinds:
        rows = out.select("email_id", F.inline(column))
        frames.append(
            rows.select(
                F.lit(kind).alias("kind"), "email_id", F.col("pos").cast("bigint").alias("pos"), "url",
                hit.alias("hit"), risk.alias("risk"), flags.alias("flags"),
            )
        )
    return frames[0].union(frames[1]).union(frames[2])


@query(
    "analysis_layers",
    f"""{LAYER_CTES} SELECT email_id, array_to_string({compact("['text_classification', CASE WHEN sender_risk IS NOT NULL THEN 'sender_analysis' END, CASE WHEN url_risk IS NOT NULL THEN 'url_analysis' END, CASE WHEN crawl_risk IS NOT NULL THEN 'web_crawling' END, CASE WHEN visual_risk IS NOT NULL THEN 'visual_analysis' END, 'ai_authorship_detection', 'xai_explanation', CASE WHEN links_risk IS NOT NULL THEN 'link_checking' END, CASE WHEN headers_risk IS NOT NULL THEN 'header_forensics' END]")}, '|') AS analysis_layers FROM lay""",
)
def _analysis_layers(spark, sf):
    return deep(spark, sf).select("email_id", bar("analysis_layers").alias("analysis_layers"))


# Weight redistribution over every mix of layers: scored emails, layers left out by the bits of their id.
_BITS = {"url": 1, "headers": 2, "links": 4, "visual": 8, "crawl": 16, "sender": 32}
_MASKED = ", ".join(f"CASE WHEN email_id & {bit} > 0 THEN {x}_risk END AS {x}_risk" for x, bit in _BITS.items())
MIX = f"{LAYER_CTES}, mx AS (SELECT * REPLACE ({_MASKED}) FROM lay)"


def mixed_layers(spark, sf):
    layers = analyzed_layers(emails(spark, sf), evidence(spark, sf), as_of=AS_OF)
    masked = {
        f"{x}_risk": F.when(F.col("email_id").bitwiseAND(bit) > 0, F.col(f"{x}_risk")) for x, bit in _BITS.items()
    }
    return layers.withColumns(masked)


@query(
    "weights_redistribution",
    f"{MIX} SELECT email_id, {round_even('weighted', 6)} AS weighted_risk, flagging AS flagging_layers, {round_even('combined')} AS overall_risk_score, verdict AS overall_verdict FROM {verdict_sql(source='mx')}",
)
def _redistribution(spark, sf):
    out = V.aggregate_risk(mixed_layers(spark, sf))
    return out.select(
        "email_id", round_to(F.col("weighted_risk"), 6).alias("weighted_risk"), "flagging_layers",
        "overall_risk_score", "overall_verdict",
    )


@query(
    "two_layer_verdicts",
    f"""{ctes("emails", "domain_registry", "tls_observations", "url_reputation")}, {PARSED},
    email_urls AS (SELECT email_id, pos, url FROM (SELECT email_id, unnest(range(len(body_urls))) AS pos, unnest(body_urls) AS url FROM parsed)), {SCORES}, {FACTS}, {ENRICHED},
    uf AS (SELECT email_id, max(risk_score) AS url_risk, coalesce(flatten(list(flags ORDER BY pos) FILTER (WHERE is_suspicious)), []::VARCHAR[]) AS uff
      FROM {scored_urls("SELECT * FROM enriched")} GROUP BY email_id),
    c AS (SELECT email_id, list_concat(CASE WHEN is_phishing THEN ['Email text classified as phishing (' || printf('%.1f', confidence * 100) || '% confidence)'] ELSE []::VARCHAR[] END,
      coalesce(uff, []::VARCHAR[])) AS fs, CASE WHEN is_phishing THEN confidence ELSE 1.0::DOUBLE - confidence END * 0.6::DOUBLE + coalesce(url_risk, 0.0::DOUBLE) * 0.4::DOUBLE AS r FROM cl LEFT JOIN uf USING (email_id))
    SELECT email_id, {round_even('r')} AS overall_risk_score, CASE WHEN r >= 0.70::DOUBLE THEN 'PHISHING' WHEN r >= 0.35::DOUBLE THEN 'SUSPICIOUS' ELSE 'SAFE' END AS overall_verdict, {joined("fs")} AS risk_factors FROM c""",
)
def _two_layer(spark, sf):
    out = full_analyze(emails(spark, sf), evidence(spark, sf), as_of=AS_OF)
    return out.select("email_id", "overall_risk_score", "overall_verdict", bar("risk_factors").alias("risk_factors"))


def ablation_sql(source: str) -> str:
    parts = []
    for number, (name, layers, ai, boost) in enumerate(V.ABLATION_STEPS):
        parts.append(
            f"""SELECT {number} AS step, {q(name)} AS layers, count(*) AS emails, count(*) FILTER (WHERE (verdict <> 'SAFE') = (label = 1)) / count(*) AS accuracy,
            CASE WHEN count(*) FILTER (WHERE label = 1) = 0 THEN NULL ELSE count(*) FILTER (WHERE label = 1 AND verdict = 'SAFE') / count(*) FILTER (WHERE label = 1) END AS false_negative_rate
            FROM {verdict_sql(layers, ai, boost, source)}"""
        )
    return " UNION ALL ".join(parts)


@query(
    "ablation",
    f"{LAYER_CTES}, lb AS (SELECT lay.*, l.toxic AS label FROM lay JOIN labels l ON l.doc_id = lay.email_id) {ablation_sql('lb')}",
)
def _ablation(spark, sf):
    labels = load_table(spark, sf, "labels").select(F.col("doc_id").alias("email_id"), F.col("toxic").alias("truth"))
    layers = analyzed_layers(emails(spark, sf), evidence(spark, sf), as_of=AS_OF)
    return V.ablate_layers(layers.join(labels, "email_id"), "truth")


@query(
    "ablation_mixed",
    f"{MIX}, lb AS (SELECT mx.*, l.quality AS label FROM mx JOIN labels l ON l.doc_id = mx.email_id) {ablation_sql('lb')}",
)
def _ablation_mixed(spark, sf):
    labels = load_table(spark, sf, "labels").select(F.col("doc_id").alias("email_id"), F.col("quality").alias("truth"))
    return V.ablate_layers(mixed_layers(spark, sf).join(labels, "email_id"), "truth")


# The text without its top word, scored again.
_ABLATED = CATS.replace("FROM emails", "FROM abl").replace("c0 AS", "xc0 AS").replace("FROM c0", "FROM xc0").replace("cats AS", "xcats AS")
_NAMED = "array_to_string(list_transform(tops[1:5], lambda t: '\"' || t || '\"'), ', ')"
_LABELLED = "[" + ", ".join(f"CASE WHEN list_contains(risk_categories, {q(f)}) THEN {q(XR.LABELS[f])} END" for f in XR.FAMILIES) + "]"
_LINES = "[" + ", ".join(f"CASE WHEN list_contains(risk_categories, {q(f)}) THEN {q(XR.EXPLANATIONS[f])} END" for f in XR.FAMILIES) + "]"
EXPLAINED = f"""{SCORES}, {TOKENS}, {scored_tokens('rules')},
  tl AS (SELECT e.email_id, coalesce(list(t.token ORDER BY t.rank) FILTER (WHERE t.rank IS NOT NULL), []::VARCHAR[]) AS tops
    FROM emails e LEFT JOIN top1 t ON e.email_id = t.email_id AND t.rank <= 10 GROUP BY e.email_id),
  abl AS (SELECT c.email_id, NULL::VARCHAR AS subject, CASE WHEN len(tops) = 0 THEN '' ELSE {strip("regexp_replace(regexp_replace(ft, '(?i)" + chr(92) + "b' || regexp_escape(tops[1]) || '" + chr(92) + "b', '', 'g'), '" + S + "{2,}', ' ', 'g')")} END AS text
    FROM cats c JOIN tl USING (email_id)),
  {_ABLATED}, xp AS (SELECT email_id, least(100, 10 + 15 * len(risk_categories))::DOUBLE / 100.0::DOUBLE AS p2 FROM xcats),
  xa AS (SELECT cl.email_id, is_phishing, confidence, p, p2, tops, risk_categories, CAST({round_even('confidence * 100', 0)} AS INTEGER) || '%' AS pct
    FROM cl JOIN cats USING (email_id) JOIN tl USING (email_id) JOIN xp USING (email_id)),
  explained AS (SELECT email_id, risk_categories, tops,
    CASE WHEN is_phishing AND len(tops) > 0 THEN {round_even("greatest(p, 1.0::DOUBLE - p) - greatest(p2, 1.0::DOUBLE - p2)")} ELSE 0.0::DOUBLE END AS top_token_confidence_delta,
    CASE WHEN is_phishing THEN array_to_string(list_filter(list_concat(list_concat(['The model classified this email as PHISHING with ' || pct || ' confidence.'], {_LINES}),
      [CASE WHEN len(tops) > 0 THEN '• Highest-attribution tokens: ' || {_NAMED} || '.' END]), lambda x: x IS NOT NULL), chr(10))
      ELSE 'The model classified this email as LEGITIMATE with ' || pct || ' confidence. No significant urgency language, credential requests, or suspicious patterns were found.' END AS explanation,
    CASE WHEN is_phishing THEN 'Flagged: ' || CASE WHEN len(risk_categories) = 0 AND len(tops) = 0 THEN 'high phishing signal' ELSE
      array_to_string(list_filter([CASE WHEN len(risk_categories) > 0 THEN 'flagged because: ' || array_to_string({compact(_LABELLED)}, ' + ') END,
        CASE WHEN len(tops) > 0 THEN 'key trigger words: ' || {_NAMED} END], lambda x: x IS NOT NULL), '; ') END
      ELSE 'Email appears legitimate — no strong phishing signals detected.' END AS summary FROM xa)"""


@query("explanations", f"{MAILS}, {EXPLAINED} SELECT email_id, explanation, summary, top_token_confidence_delta FROM explained")
def _explanations(spark, sf):
    return explained(emails(spark, sf)).select(
        "email_id", "explanation", "summary", "top_token_confidence_delta"
    )


# Robustness
def _variant_sql() -> str:
    cols = "SELECT email_id, {kind} AS attack_type, {name} AS variant_name, {text} AS adversarial_text, {probe} AS probe FROM emails WHERE length(text) >= 10"
    parts = []
    for brand in RR.BRANDS:
        v = RO.brand_variant(brand)
        t = f"replace(text, {q(brand)}, {q(v)})"
        parts.append(cols.format(kind="'homoglyph'", name=q(f"{brand} → {v}"), text=t, probe=t) + f" AND contains(lower(text), {q(brand)})")
    for char, name in RR.ZERO_WIDTH.items():
        t = f"regexp_replace(text, '(?s)(.{{10}})', '\\1' || chr({ord(char)}), 'g')".replace("{", "{{").replace("}", "}}").replace("{{", "{").replace("}}", "}")
        parts.append(cols.format(kind="'zero_width'", name=q(f"Injected {name} every 10 chars"), text=t, probe=t))
    for plain, disguised in RR.DISGUISED_URLS:
        t = f"text || chr(10) || chr(10) || {q('Click here: ' + disguised)}"
        parts.append(cols.format(kind="'url_obfuscation'", name=q(f"{plain[:40]} → {disguised[:40]}"), text=t, probe=q(disguised)))
    for phrase in RR.EVASION_PHRASES:
        t = f"{q(phrase)} || chr(10) || chr(10) || text"
        parts.append(cols.format(kind="'prompt_evasion'", name=q(f'Prepended: "{phrase[:60]}…"'), text=t, probe=t))
    return "variants AS (" + " UNION ALL ".join(parts) + ")"


VARIANTS = _variant_sql()


def _variant_query(name: str, kind: str) -> None:
    sql = f"{MAILS}, {VARIANTS} SELECT email_id, variant_name, md5(adversarial_text) AS text_md5 FROM variants WHERE attack_type = {q(kind)}"

    def run(spark, sf):
        return RO.variants(emails(spark, sf), [kind]).select(
            "email_id", "variant_name", F.md5("adversarial_text").alias("text_md5")
        )

    query(name, sql)(run)


_variant_query("homoglyph_variants", "homoglyph")
_variant_query("zero_width_variants", "zero_width")
_variant_query("url_variants", "url_obfuscation")
_variant_query("prompt_variants", "prompt_evasion")

ZW = "[" + "".join(RR.ZERO_WIDTH) + "]"
_SPOOFS = RO.spoofed_spellings()
HOMO = (
    "list_filter([" + ", ".join(
        f"CASE WHEN contains(lower({{x}}), {q(s)}) THEN {q(f'Homoglyph brand spoof detected: {chr(39)}{s}{chr(39)} (mimics {chr(39)}{b}{chr(39)})')} END"
        for s, b in _SPOOFS
    ) + "], lambda z: z IS NOT NULL)"
)
PROMPT = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower({{x}}), {q(rx(p))}) THEN {q(n)} END" for p, n in RR.PROMPT_PATTERNS) + "], lambda z: z IS NOT NULL)"
_B = "|".join(RR.BRANDS)
_HOST = "CASE WHEN contains({x}, '/') THEN split_part({x}, '/', 3) ELSE {x} END"
OBFUSCATED = (
    "list_filter([CASE WHEN regexp_matches({x}, 'https?://[^/]+@') THEN 'URL contains @ trick (credential/host confusion)' END, "
    f"CASE WHEN regexp_matches({_HOST}, '%[0-9a-fA-F]{{{{2}}}}') THEN 'Hex-encoded characters in domain' END, "
    "CASE WHEN regexp_matches({x}, '^https?://[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}') THEN 'IP address used instead of domain name' END, "
    f"CASE WHEN len({hits('{x}', RR.SHORTENERS)}) > 0 THEN 'URL shortener detected' END, "
    f"CASE WHEN regexp_matches({{x}}, '({_B})\\.com\\.') THEN 'Subdomain deception: ''' || regexp_extract({{x}}, '({_B})\\.com\\.') || ''' prefix on external domain' END, "
    f"CASE WHEN regexp_matches(CASE WHEN contains({{x}}, '//') THEN {_HOST} ELSE {{x}} END, '[^\\x00-\\x7f]') THEN 'Non-ASCII (IDN/homoglyph) characters in domain' END, "
    "CASE WHEN regexp_matches({x}, '\\.com//[^/]') THEN 'Double-slash path confusion after domain' END], lambda z: z IS NOT NULL)"
)


def on(expr: str, x: str) -> str:
    return expr.replace("{x}", x).replace("{{", "{").replace("}}", "}")


@query("detect_zero_width", f"{MAILS}, {VARIANTS} SELECT attack_type, count(*) AS variants, count(*) FILTER (WHERE regexp_matches(adversarial_text, '{ZW}')) AS hits FROM variants GROUP BY attack_type")
def _zero_width(spark, sf):
    rows = RO.variants(emails(spark, sf))
    return rows.groupBy("attack_type").agg(
        F.count(F.lit(1)).alias("variants"),
        F.count_if(RO.detect_zero_width(F.col("adversarial_text"))).alias("hits"),
    )


@query("detect_homoglyph", f"{MAILS}, {VARIANTS} SELECT email_id, variant_name, {joined(on(HOMO, 'adversarial_text'))} AS notes FROM variants WHERE attack_type = 'homoglyph'")
def _homoglyph(spark, sf):
    rows = RO.variants(emails(spark, sf), ["homoglyph"])
    return rows.select(
        "email_id", "variant_name", bar(RO.detect_homoglyph_brands(F.col("adversarial_text"))).alias("notes")
    )


@query("detect_prompt_phrases", f"{MAILS}, {VARIANTS} SELECT email_id, variant_name, {joined(on(PROMPT, 'adversarial_text'))} AS notes FROM variants WHERE attack_type = 'prompt_evasion'")
def _prompt(spark, sf):
    rows = RO.variants(emails(spark, sf), ["prompt_evasion"])
    return rows.select(
        "email_id", "variant_name", bar(RO.detect_prompt_phrases(F.col("adversarial_text"))).alias("notes")
    )


@query("detect_url_obfuscation", f"{MAILS}, {PARSED}, {EMAIL_URLS}, u AS (SELECT url FROM email_urls UNION ALL SELECT url FROM pages) SELECT url, count(*) AS n, {joined(on(OBFUSCATED, 'url'))} AS notes FROM u GROUP BY url")
def _obfuscated(spark, sf):
    from checks.urls import parsed
    from mailsieve.operators.urls import explode_urls

    found = explode_urls(parsed(spark, sf)).select("url").unionAll(load_table(spark, sf, "pages").select("url"))
    counted = found.groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("notes", bar(RO.detect_url_obfuscation(F.col("url"))))


_VCATS = CATS.replace("FROM emails", "FROM vin").replace("c0 AS", "vc0 AS").replace("FROM c0", "FROM vc0").replace("cats AS", "vcats AS")
ROBUST = f"""{MAILS}, {SCORES}, {VARIANTS}, vin AS (SELECT v.email_id * 100 + row_number() OVER (PARTITION BY v.email_id ORDER BY variant_name) AS email_id, e.subject, adversarial_text AS text, v.email_id AS orig, attack_type, variant_name, probe
    FROM variants v JOIN emails e USING (email_id)), {_VCATS},
  res AS (SELECT vin.orig AS email_id, vin.attack_type, vin.variant_name, p AS original_score, least(100, 10 + 15 * len(vcats.risk_categories))::DOUBLE / 100.0::DOUBLE AS adversarial_score,
    CASE attack_type WHEN 'homoglyph' THEN {on(HOMO, "probe")} WHEN 'zero_width' THEN CASE WHEN regexp_matches(probe, '{ZW}') THEN ['Zero-width character detected by heuristic layer'] ELSE []::VARCHAR[] END
      WHEN 'url_obfuscation' THEN {on(OBFUSCATED, "probe")} ELSE {on(PROMPT, "probe")} END AS notes
    FROM vin JOIN vcats USING (email_id) JOIN cl ON cl.email_id = vin.orig),
  out AS (SELECT *, len(notes) > 0 AS heuristic_caught, adversarial_score < 0.5::DOUBLE AS classifier_fooled, adversarial_score < 0.5::DOUBLE AND NOT len(notes) > 0 AS evasion_success FROM res)"""


_CONF = "greatest({x}, 1.0::DOUBLE - {x})"
_AFTER = _CONF.format(x="adversarial_score")


@query(
    "robustness",
    f"""{ROBUST} SELECT email_id, attack_type, variant_name, original_score, adversarial_score, {round_even('adversarial_score - original_score')} AS score_delta,
    {round_even(_CONF.format(x="original_score"))} AS original_confidence, {round_even(_AFTER)} AS adversarial_confidence, heuristic_caught, classifier_fooled,
    {_AFTER} < 0.5::DOUBLE AS fooled_by_confidence, evasion_success,
    array_to_string(list_concat(CASE WHEN heuristic_caught THEN notes ELSE [CASE attack_type WHEN 'homoglyph' THEN 'Homoglyph not caught by heuristic layer'
        WHEN 'zero_width' THEN 'Zero-width character NOT detected by heuristic layer' WHEN 'url_obfuscation' THEN 'URL obfuscation not caught by heuristic layer'
        ELSE 'Evasion phrase not caught by heuristic layer' END] END,
      CASE WHEN classifier_fooled THEN []::VARCHAR[] ELSE [CASE WHEN attack_type = 'homoglyph' THEN 'Classifier still confident: ' ELSE 'Classifier resilient: ' END
        || printf('%.1f', {_AFTER} * 100) || '%'] END), '|') AS detection_notes FROM out""",
)
def _robustness(spark, sf):
    out = RO.robustness(emails(spark, sf), SC.RuleScorer()).drop("adversarial_text")
    return out.withColumn("detection_notes", bar("detection_notes"))


@query(
    "attack_breakdown",
    f"""{ROBUST} SELECT k AS attack_type, count(attack_type) AS tested, count(*) FILTER (WHERE evasion_success) AS evaded
    FROM (SELECT unnest({lst(RR.ATTACKS)}) AS k) LEFT JOIN out ON attack_type = k GROUP BY k""",
)
def _breakdown(spark, sf):
    return RO.attack_breakdown(RO.robustness(emails(spark, sf), SC.RuleScorer()))


_RATE = round_even("evasion_successes / total_tests")
_SUMMARY = """CASE WHEN resilience_score >= 0.9::DOUBLE THEN 'Strong adversarial resilience (' || pct || '%) — ' || ev || ' attack variants evaded detection.'
  WHEN resilience_score >= 0.7::DOUBLE THEN 'Moderate resilience (' || pct || '%) — ' || ev || ' variants evaded. Heuristic hardening recommended.'
  ELSE 'Low resilience (' || pct || '%) — ' || ev || ' variants evaded. Significant hardening required.' END"""


@query(
    "robustness_report",
    f"""{ROBUST}, t AS (SELECT email_id, count(*) AS total_tests, count(*) FILTER (WHERE evasion_success) AS evasion_successes FROM out GROUP BY email_id),
    r0 AS (SELECT *, {_RATE} AS evasion_rate, evasion_successes || '/' || total_tests AS ev FROM t),
    r AS (SELECT *, {round_even('1.0::DOUBLE - evasion_rate')} AS resilience_score FROM r0),
    p AS (SELECT *, CAST(round_even(resilience_score * 100, 0) AS INTEGER) AS pct FROM r)
    SELECT email_id, total_tests, evasion_successes, evasion_rate, resilience_score, {_SUMMARY} AS summary FROM p""",
)
def _report(spark, sf):
    out = RO.robustness_report(RO.robustness(emails(spark, sf), SC.RuleScorer()), by=["email_id"])
    return out.drop("attack_breakdown")


# Log and export
@query(
    "history_top10",
    """SELECT event_id, event_type, ts AS at FROM events ORDER BY ts DESC, event_id DESC LIMIT 10""",
)
def _history(spark, sf):
    log = load_table(spark, sf, "events").select(
        F.col("event_id").alias("email_id"), "event_type", F.col("ts").alias("at")
    )
    return sinks.history(log).withColumnRenamed("email_id", "event_id")


@query(
    "verdict_log",
    f"""{LAYER_CTES} SELECT email_id, CASE WHEN coalesce(subject, '') <> '' THEN subject || ' — ' ELSE '' END || left(text, 120) AS preview, verdict, {round_even('combined')} AS risk_score,
    3 + (sender_risk IS NOT NULL)::INTEGER + (url_risk IS NOT NULL)::INTEGER + (crawl_risk IS NOT NULL)::INTEGER + (visual_risk IS NOT NULL)::INTEGER + (links_risk IS NOT NULL)::INTEGER + (headers_risk IS NOT NULL)::INTEGER AS layers
    FROM {verdict_sql()} JOIN emails USING (email_id)""",
)
def _log(spark, sf):
    mails = emails(spark, sf)
    rows = deep(spark, sf).join(mails.select("email_id", "subject", "text", "received_at"), "email_id")
    path = f"{shared_dir(spark)}/verdict-log-{uuid.uuid4().hex}"
    entries = written(sinks.log_entries(rows), "log-entries")
    sinks.append_log(entries.filter("email_id % 2 = 0"), path, 0)
    for _ in range(2):  # a batch that is tried again
        sinks.append_log(entries.filter("email_id % 2 = 1"), path, 1)
    return sinks.read_log(spark, path).drop("at", "batch")


@query("log_latest10", """SELECT event_id, event_type, ts AS at FROM events ORDER BY ts DESC, event_id DESC LIMIT 10""")
def _log_latest(spark, sf):
    """Events logged in six batches, the last one twice; the newest ten."""
    log = load_table(spark, sf, "events").select(F.col("event_id").alias("email_id"), "event_type", F.col("ts").alias("at"))
    path = f"{shared_dir(spark)}/event-log-{uuid.uuid4().hex}"
    for batch in (0, 1, 2, 3, 4, 5, 5):
        sinks.append_log(log.filter(F.col("email_id") % 6 == batch), path, batch)
    return sinks.latest(spark, path).select(F.col("email_id").alias("event_id"), "event_type", "at")


@query(
    "json_export",
    f"""{LAYER_CTES} SELECT email_id, verdict AS overall_verdict, {round_even('combined')} AS overall_risk_score,
    headers_risk, coalesce(array_to_string(header_flags, '|'), '') AS header_flags, sender_risk FROM {verdict_sql()}""",
)
def _json(spark, sf):
    """The exported documents, read back."""
    names = ["email_id", "overall_verdict", "overall_risk_score", "headers", "sender_check"]
    out = deep(spark, sf).select(*names)
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    sinks.to_json_export(out).write.text(path)
    back = spark.read.schema(out.schema).json(path)
    return back.select(
        "email_id", "overall_verdict", "overall_risk_score", F.col("headers.risk_score").alias("headers_risk"),
        F.coalesce(bar("headers.flags"), F.lit("")).alias("header_flags"), F.col("sender_check.risk_score").alias("sender_risk"),
    )
