"""All layers of an email table in one plan.

The text layers (classifier, sender, headers, authorship, URL extraction) are narrow and
run in the scan; from there only compact columns travel. URLs become rows once, meet the
domain facts, the page and chain facts and the reputation by equi joins with the URL rows on the left,
and come back to one row per email in a single aggregation. Texts, HTML and header blocks
never cross an exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.functions.columns import leading
from mailsieve.functions.text import full_text
from mailsieve.operators.authorship import authorship
from mailsieve.operators.explain import (
    ablate_top_token,
    attribute_tokens,
    explain,
    top_tokens,
    with_risk_categories,
)
from mailsieve.operators.headers import score_headers
from mailsieve.operators.links import link_aggregates, link_chains, link_score, score_links
from mailsieve.operators.pages import page_aggregates, page_facts
from mailsieve.operators.parsing import merge_html_urls, parse_emails
from mailsieve.operators.scoring import RuleScorer, classify
from mailsieve.operators.senders import FIELDS as SENDER_FIELDS
from mailsieve.operators.senders import score_senders
from mailsieve.operators.urls import domain_facts, explode_urls, reputation_facts, score_urls
from mailsieve.functions.urls import url_domain
from mailsieve.operators.verdicts import aggregate_risk, ai_factor, phishing_factor, two_layer_risk


@dataclass
class Evidence:
    """Optional tables beside the emails; a missing table leaves its layer out."""

    registry: DataFrame | None = None
    tls: DataFrame | None = None
    reputation: DataFrame | None = None
    pages: DataFrame | None = None
    hops: DataFrame | None = None


@dataclass
class Limits:
    """Optional cuts of the analysis; None, the default, looks at everything.

    pages and links: first URLs of an email that get page and redirect checks.
    page_flags, url_flags and layer_flags: first flags of each that become risk factors.
    """

    pages: int | None = None
    links: int | None = None
    page_flags: int | None = None
    url_flags: int | None = None
    layer_flags: int | None = None


def _first(n: int | None) -> Column:
    return F.lit(True) if n is None else F.col("pos") < n


OPTIONAL = {
    "subject": "string", "email_html": "string", "raw_headers": "string",
    "crawl_urls": "boolean", "take_screenshots": "boolean",
    **dict.fromkeys(SENDER_FIELDS, "string"),
}


def with_optional(emails: DataFrame) -> DataFrame:
    """Add the optional request columns that are missing, as NULL or false."""
    missing = {}
    for name, kind in OPTIONAL.items():
        if name not in emails.columns:
            value = F.lit(False) if kind == "boolean" else F.lit(None).cast(kind)
            missing[name] = value
    return emails.withColumns(missing) if missing else emails


EXPLANATION = ["risk_categories", "top_tokens", "top_token_confidence_delta", "explanation", "summary"]


def mail_layers(emails: DataFrame, scorer, as_of: str, explaining: bool = False) -> DataFrame:
    """Layers that need the email alone, as compact columns. Narrow.

    explaining adds a struct xai: categories, top words, the effect of the first of them
    and the readable texts.
    """
    base = merge_html_urls(parse_emails(with_optional(emails)))
    base = classify(scorer.score(base))
    base = authorship(score_headers(score_senders(base), as_of))
    if explaining:
        base = _explained(base, scorer).withColumn("xai", F.struct(*EXPLANATION))
    return base.select(
        "email_id", "is_phishing", "confidence", "label", "risk_level", "urls", "sender_check",
        "headers", "authorship", *(["xai"] if explaining else []),
    )


def _explained(classified: DataFrame, scorer, weights: DataFrame | None = None) -> DataFrame:
    base = with_risk_categories(classified, full_text(F.col("subject"), F.col("text")))
    return explain(ablate_top_token(top_tokens(attribute_tokens(base, weights)), scorer))


def url_rows(emails: DataFrame) -> DataFrame:
    """email_id, pos, url, first_seen and the crawl switches, one row per URL. Narrow."""
    parsed = merge_html_urls(parse_emails(with_optional(emails)))
    switches = F.struct(
        F.coalesce("crawl_urls", F.lit(False)).alias("crawl_urls"),
        F.coalesce("take_screenshots", F.lit(False)).alias("take_screenshots"),
    )
    keyed = parsed.select(F.struct("email_id", switches.alias("s")).alias("email_id"), "urls")
    return explode_urls(keyed).select("email_id.email_id", "email_id.s.*", "pos", "url", "first_seen")


def url_facts(evidence: Evidence, as_of: str, limits: Limits) -> DataFrame | None:
    """Everything known per URL: reputation, newest page, redirect chain. One row per URL."""
    parts = []
    if evidence.reputation is not None:
        parts.append(reputation_facts(evidence.reputation, as_of))
    if evidence.pages is not None:
        parts.append(page_facts(evidence.pages, as_of, limits.page_flags).withColumn("has_page", F.lit(True)))
    if evidence.hops is not None:
        scored = score_links(link_chains(evidence.hops))
        parts.append(
            scored.select(
                "url",
                F.col("flags").alias("link_flags"),
                F.col("is_suspicious").alias("link_suspicious"),
            )
        )
    facts = None
    for part in parts:
        facts = part if facts is None else facts.join(part, "url", "full")
    return facts


def url_layers(
    emails: DataFrame, evidence: Evidence, as_of: str, strict_brands: bool, limits: Limits,
    details: bool = False,
) -> DataFrame:
    """URL, page and link findings per email, in one aggregation."""
    rows = url_rows(emails)
    domains = domain_facts(evidence.registry, evidence.tls, as_of)
    if domains is not None:
        keyed = rows.withColumn("domain", url_domain(F.col("url")))
        rows = keyed.join(domains, "domain", "left").drop("domain")
    facts = url_facts(evidence, as_of, limits)
    if facts is not None:
        rows = rows.join(facts, "url", "left")
    scored = score_urls(rows, strict_brands)
    factor = F.when(F.col("is_suspicious"), F.struct("pos", leading(F.col("flags"), limits.url_flags).alias("f")))
    in_order = F.sort_array(F.collect_list(factor))
    aggregates: list[Column] = [
        F.count(F.lit(1)).alias("total_urls"),
        F.count_if("is_suspicious").alias("suspicious_count"),
        F.max("risk_score").alias("url_risk"),
        F.flatten(F.transform(in_order, lambda x: x["f"])).alias("url_factors"),
    ]
    if evidence.pages is not None:
        crawled = F.col("crawl_urls") & _first(limits.pages) & F.coalesce("has_page", F.lit(False))
        aggregates += page_aggregates(crawled)
    if evidence.hops is not None:
        checked = F.col("first_seen") & _first(limits.links)
        aggregates += link_aggregates(checked)
    if details:
        aggregates += _details(scored, evidence, limits)
    return scored.groupBy("email_id").agg(*aggregates)


URL_RESULT = [
    "pos", "url", "domain", "is_suspicious", "risk_score", "flags", "domain_age_days",
    "registrar", "ssl_valid", "ssl_issuer", "vt_malicious",
]
CRAWL_RESULT = ["pos", "url", "error", "has_password_field", "has_login_form"]
VISUAL_RESULT = ["pos", "url", "visual_risk", "is_fake_login", "impersonated_brand", "visual_flags"]


def _details(scored: DataFrame, evidence: Evidence, limits: Limits) -> list[Column]:
    """Results per URL, crawled page and page shown; as long as the email's own URL list."""

    def listed(names: list[str], which: Column, out: str) -> Column:
        return F.sort_array(F.collect_list(F.when(which, F.struct(*names)))).alias(out)

    parts = [listed(URL_RESULT, F.lit(True), "url_results")]
    if evidence.pages is not None:
        crawled = F.col("crawl_urls") & _first(limits.pages) & F.coalesce("has_page", F.lit(False))
        shown = crawled & F.col("take_screenshots") & F.col("error").isNull()
        parts += [listed(CRAWL_RESULT, crawled, "crawl_results"), listed(VISUAL_RESULT, shown, "visual_results")]
    return parts


def _layer_risks(df: DataFrame, evidence: Evidence, drop_failed: bool) -> DataFrame:
    """One <layer>_risk column per layer, NULL where the layer did not run."""
    none = F.lit(None).cast("double")
    pages = F.col("pages_loaded") if drop_failed else F.col("pages_crawled")
    has_pages, has_hops = evidence.pages is not None, evidence.hops is not None
    return df.withColumns(
        {
            "headers_risk": F.col("headers.risk_score"),
            "sender_risk": F.col("sender_check.risk_score"),
            "links_risk": F.when(F.col("total_urls") > 0, link_score()) if has_hops else none,
            "visual_risk": F.when(F.col("pages_shown") > 0, F.col("visual_risk")) if has_pages else none,
            "crawl_risk": F.when(pages > 0, F.col("crawl_risk")) if has_pages else none,
            "is_ai_generated": F.col("authorship.is_ai_generated"),
            "ai_authorship_score": F.col("authorship.ai_authorship_score"),
        }
    )


def _factors(evidence: Evidence, limits: Limits) -> Column:
    """Reasons in layer order, each once."""
    none = F.array().cast("array<string>")

    def of_layer(flags: str, suspicious: Column) -> Column:
        return F.when(suspicious, leading(F.col(flags), limits.layer_flags)).otherwise(none)

    parts = [
        F.array_compact(F.array(F.when(F.col("is_phishing"), phishing_factor()))),
        of_layer("sender_check.flags", F.col("sender_check.is_suspicious")),
        F.coalesce("url_factors", none),
    ]
    if evidence.pages is not None:
        parts += [F.coalesce("visual_factors", none), F.coalesce("crawl_factors", none)]
    parts.append(F.array_compact(F.array(F.when(F.col("is_ai_generated"), ai_factor()))))
    if evidence.hops is not None:
        parts.append(of_layer("link_flags", F.col("suspicious_links") > 0))
    parts.append(of_layer("headers.flags", F.col("headers.is_suspicious")))
    return F.array_distinct(F.concat(*parts))


def _layers(explaining: bool) -> Column:
    """Names of the layers that ran, in running order."""
    ran = [
        ("text_classification", F.lit(True)),
        ("sender_analysis", F.col("sender_risk").isNotNull()),
        ("url_analysis", F.col("url_risk").isNotNull()),
        ("web_crawling", F.col("crawl_risk").isNotNull()),
        ("visual_analysis", F.col("visual_risk").isNotNull()),
        ("ai_authorship_detection", F.lit(True)),
        ("xai_explanation", F.lit(explaining)),
        ("link_checking", F.col("links_risk").isNotNull()),
        ("header_forensics", F.col("headers_risk").isNotNull()),
    ]
    return F.array_compact(F.array(*[F.when(there, F.lit(name)) for name, there in ran]))


def analyzed_layers(
    emails: DataFrame,
    evidence: Evidence | None = None,
    scorer=None,
    as_of: str = "",
    strict_brands: bool = False,
    drop_failed_layers: bool = False,
    limits: Limits | None = None,
    explaining: bool = False,
    details: bool = False,
) -> DataFrame:
    """Layer results and layer risks per email, before they are combined."""
    evidence = evidence or Evidence()
    mails = mail_layers(emails, scorer or RuleScorer(), as_of, explaining)
    urls = url_layers(emails, evidence, as_of, strict_brands, limits or Limits(), details)
    joined = mails.join(urls, "email_id", "left")
    return _layer_risks(joined, evidence, drop_failed_layers)


def deep_analyze(
    emails: DataFrame,
    evidence: Evidence | None = None,
    scorer=None,
    as_of: str = "",
    strict_brands: bool = False,
    drop_failed_layers: bool = False,
    limits: Limits | None = None,
    explaining: bool = True,
    details: bool = False,
) -> DataFrame:
    """Verdict, score, reasons, explanation and layer results for each email.

    emails: email_id, text and any of subject, email_html, raw_headers, the sender fields,
    crawl_urls and take_screenshots. as_of is the moment ages are measured against.
    explaining adds the struct xai; details adds url_results, crawl_results and
    visual_results, one struct per URL in order of place.
    """
    evidence = evidence or Evidence()
    layers = analyzed_layers(
        emails, evidence, scorer, as_of, strict_brands, drop_failed_layers, limits, explaining, details
    )
    return aggregate_risk(layers).withColumns(
        {
            "risk_factors": _factors(evidence, limits or Limits()),
            "analysis_layers": _layers(explaining),
        }
    )


def full_analyze(
    emails: DataFrame,
    evidence: Evidence | None = None,
    scorer=None,
    as_of: str = "",
    limits: Limits | None = None,
) -> DataFrame:
    """Two-layer verdict from text and URLs."""
    evidence = evidence or Evidence()
    base = parse_emails(with_optional(emails))
    mails = classify((scorer or RuleScorer()).score(base)).select(
        "email_id", "is_phishing", "confidence", "urls"
    )
    plain = with_optional(emails).withColumn("email_html", F.lit(None).cast("string"))
    urls = url_layers(
        plain,
        Evidence(evidence.registry, evidence.tls, evidence.reputation),
        as_of,
        False,
        limits or Limits(),
    )
    both = two_layer_risk(mails.join(urls, "email_id", "left"))
    text = F.array_compact(F.array(F.when(F.col("is_phishing"), phishing_factor())))
    found = F.coalesce("url_factors", F.array().cast("array<string>"))
    return both.withColumn("risk_factors", F.concat(text, found))


def explained(emails: DataFrame, scorer=None, weights: DataFrame | None = None) -> DataFrame:
    """Classifier result with categories, top words, delta and readable explanation."""
    scorer = scorer or RuleScorer()
    return _explained(classify(scorer.score(with_optional(emails))), scorer, weights)
