"""Page layer over stored pages: HTML features, fake-login rules, per-email roll up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.functions.columns import (
    Rule,
    contained,
    contains_any,
    flags_of,
    leading,
    points_of,
    score_of,
    sql_array,
    sql_text,
    title_case,
)
from mailsieve.functions.text import squeeze
from mailsieve.functions.urls import url_host
from mailsieve.operators.urls import latest
from mailsieve.rules import pages as R

TITLE = r"(?is)<title(?:\s[^>]*)?>(.*?)</title"
FORM = r"(?is)<form(?:\s[^>]*)?>.*?(?:</form\s*>|\z)"
INPUT = r"(?is)<input(?:\s[^>]*|/)?>"
ANCHOR = r"(?is)<a\s[^>]*>"
NOT_SHOWN = (
    r"(?is)<head(?:\s[^>]*)?>.*?</head\s*>|<script(?:\s[^>]*)?>.*?</script\s*>"
    r"|<style(?:\s[^>]*)?>.*?</style\s*>|<!--.*?-->|<[^>]+>"
)
# The five entities that are resolved, '&' last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def unescape(text: Column) -> Column:
    out = text
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in a tag, '' if it is missing."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, pattern, g) for g in (1, 2, 3)])


def page_features(
    df: DataFrame, max_text: int | None = None, max_anchors: int | None = None
) -> DataFrame:
    """Features of stored pages: url, final_url, status_code, html, redirect_chain, error.

    The whole visible text and all anchors are kept unless max_text or max_anchors ask for
    the head of them. Pages that did not load have empty features.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    final = F.coalesce(F.col("final_url"), F.lit(""))
    loaded = F.coalesce(
        (final != "") & (final != "about:blank") & F.col("status_code").isNotNull(), F.lit(False)
    )
    tags = df.withColumns({"_html": F.when(loaded, html).otherwise(""), "_loaded": loaded})
    tags = tags.withColumns(
        {
            "_forms": F.regexp_extract_all("_html", F.lit(FORM), F.lit(0)),
            "_inputs": F.regexp_extract_all("_html", F.lit(INPUT), F.lit(0)),
            "_anchors": F.regexp_extract_all("_html", F.lit(ANCHOR), F.lit(0)),
        }
    )
    form_inputs = F.flatten(
        F.transform("_forms", lambda f: F.regexp_extract_all(f, F.lit(INPUT), F.lit(0)))
    )

    def described(tag: Column) -> Column:
        kind = attribute(tag, "type")
        kind = F.when(kind == "", F.lit("text")).otherwise(kind)
        return F.concat(kind, F.lit(":"), attribute(tag, "name"))

    text = squeeze(unescape(F.regexp_replace("_html", NOT_SHOWN, " ")))
    links = F.filter("_anchors", lambda a: F.rlike(a, F.lit(r"(?is)\shref\s*=")))
    hrefs = F.transform(leading(links, max_anchors), lambda a: attribute(a, "href"))
    features = tags.withColumns(
        {
            "page_title": squeeze(unescape(F.regexp_extract("_html", TITLE, 1))),
            "page_text": text if max_text is None else F.substring(text, 1, max_text),
            "form_actions": F.transform("_forms", lambda f: attribute(_opening(f), "action")),
            "input_fields": F.transform(form_inputs, described),
            "has_password_field": F.exists(
                "_inputs", lambda i: F.lower(attribute(i, "type")) == "password"
            ),
            "external_links": F.filter(
                hrefs,
                lambda h: F.startswith(h, F.lit("http")) & (url_host(h) != url_host(F.col("final_url"))),
            ),
            "was_redirected": F.col("_loaded") & (F.col("final_url") != F.col("url")),
        }
    )
    keyword_field = F.exists(
        "input_fields", lambda i: contains_any(F.lower(i), R.LOGIN_FIELD_WORDS)
    )
    return features.withColumn("has_login_form", F.col("has_password_field") | keyword_field).drop(
        "_html", "_loaded", "_forms", "_inputs", "_anchors", "html"
    )


def _opening(form: Column) -> Column:
    """Opening tag of a form."""
    return F.regexp_extract(form, r"(?s)^<[^>]*>", 0)


def _signatures() -> Column:
    rows = [
        f"named_struct('brand', {sql_text(brand)}, 'titles', {sql_array(titles)}, "
        f"'words', {sql_array(words)}, 'domains', {sql_array(domains)})"
        for brand, (titles, words, domains) in R.BRAND_PAGES.items()
    ]
    return F.expr(f"array({', '.join(rows)})")


def _is_own_domain(signature: Column, domain: Column) -> Column:
    return F.exists(
        signature["domains"],
        lambda d: (domain == d) | F.endswith(domain, F.concat(F.lit("."), d)),
    )


def impersonated_brands(domain: Column, title: Column, text: Column) -> Column:
    """Brands with two or more hits in title and text on a domain not theirs."""
    return F.transform(
        F.filter(
            _signatures(),
            lambda s: (
                F.size(F.filter(s["titles"], lambda t: F.contains(title, t)))
                + F.size(F.filter(s["words"], lambda w: F.contains(text, w)))
                >= 2
            )
            & ~_is_own_domain(s, domain),
        ),
        lambda s: s["brand"],
    )


def title_brands(domain: Column, title: Column) -> Column:
    """Brands the title suggests on a domain not theirs."""
    return F.transform(
        F.filter(
            _signatures(),
            lambda s: F.exists(s["titles"], lambda t: F.contains(title, t))
            & ~_is_own_domain(s, domain),
        ),
        lambda s: s["brand"],
    )


def score_pages(df: DataFrame, named_fields: int = 5, named_phrases: int = 3) -> DataFrame:
    """Add flags, risk_score, is_fake_login, impersonated_brand, brand_matches and
    suspicious_elements to page features. Narrow: no shuffle."""
    shown = F.when(F.col("final_url") != "", F.col("final_url")).otherwise(F.col("url"))
    base = df.withColumns(
        {
            "_host": url_host(shown),
            "_title": F.lower("page_title"),
            "_text": F.lower("page_text"),
        }
    ).withColumn("_domain", F.lower("_host"))
    found = base.withColumns(
        {
            "brand_matches": impersonated_brands(F.col("_domain"), F.col("_title"), F.col("_text")),
            "_title_brands": F.when(
                F.col("has_login_form"), title_brands(F.col("_domain"), F.col("_title"))
            ).otherwise(F.array().cast("array<string>")),
            "_foreign": F.filter(
                F.transform(
                    F.filter("form_actions", lambda a: F.startswith(a, F.lit("http"))), url_host
                ),
                lambda h: h != F.col("_host"),
            ),
            "_credentials": F.filter(
                "input_fields", lambda i: contains_any(F.lower(i), R.CREDENTIAL_FIELD_WORDS)
            ),
            "_urgent": contained(F.col("_text"), R.URGENCY_PHRASES),
            "_sensitive": contained(F.col("_text"), R.SENSITIVE_PHRASES),
            "_from_host": url_host(F.col("url")),
            "_to_host": url_host(F.col("final_url")),
            "_hops": F.coalesce(F.size("redirect_chain"), F.lit(0)),
        }
    )
    points = R.POINTS
    many_fields = F.size("_credentials") >= 2
    single = [
        Rule(
            many_fields,
            F.concat(
                F.lit("Multiple credential input fields: "),
                F.array_join(F.slice("_credentials", 1, named_fields), ", "),
            ),
            points["credential_fields"],
        ),
        Rule(
            F.size("_urgent") > 0,
            F.concat(
                F.lit("Urgency language detected: "),
                F.array_join(F.slice("_urgent", 1, named_phrases), ", "),
            ),
            points["urgency"],
        ),
        Rule(
            F.size("_sensitive") > 0,
            F.concat(
                F.lit("Requests sensitive data: "),
                F.array_join(F.slice("_sensitive", 1, named_phrases), ", "),
            ),
            points["sensitive"],
        ),
    ]
    redirects = [
        Rule(
            F.col("was_redirected") & (F.col("_from_host") != F.col("_to_host")),
            F.concat(
                F.lit("Redirected to different domain: "), "_from_host", F.lit(" → "), "_to_host"
            ),
            points["other_domain"],
        ),
        Rule(
            F.col("was_redirected") & (F.col("_hops") > R.MAX_HOPS),
            F.format_string("Multiple redirects (%d hops)", "_hops"),
            points["many_hops"],
        ),
    ]
    password = F.col("has_password_field")
    login = [
        Rule(F.size("brand_matches") > 0, "", points["any_brand"]),
        Rule(password & F.col("has_login_form"), "", points["login_and_password"]),
        Rule(password & ~F.col("has_login_form"), "", points["password_only"]),
    ]
    impersonates = F.transform(
        "brand_matches",
        lambda b: F.concat(
            F.lit("Page impersonates "), title_case(b), F.lit(" but hosted on "), F.col("_domain")
        ),
    )
    foreign = F.transform(
        "_foreign", lambda h: F.concat(F.lit("Form submits data to external domain: "), h)
    )
    suggests = F.transform(
        "_title_brands",
        lambda b: F.concat(
            F.lit("Login page title suggests "), title_case(b), F.lit(" but domain is "), F.col("_domain")
        ),
    )
    total = (
        points_of(login + single + redirects)
        + F.size("brand_matches") * points["brand_flag"]
        + F.size("_foreign") * points["foreign_form"]
    )
    elements = F.concat(
        F.array_compact(F.array(F.when(password, F.lit("Password input field detected")))),
        F.transform("_foreign", lambda _: F.lit("Cross-domain form submission")),
    )
    scored = found.withColumns(
        {
            "flags": F.concat(impersonates, foreign, flags_of(single), suggests, flags_of(redirects)),
            "_points": total,
            "impersonated_brand": F.try_element_at("brand_matches", F.lit(-1)),
            "suspicious_elements": elements,
        }
    )
    return scored.withColumns(
        {
            "risk_score": score_of(F.col("_points")),
            "is_fake_login": F.col("_points") >= R.FAKE_LOGIN_AT,
        }
    ).drop(
        "_host", "_title", "_text", "_domain", "_title_brands", "_foreign", "_credentials",
        "_urgent", "_sensitive", "_from_host", "_to_host", "_hops", "_points",
    )


def crawl_points() -> Column:
    """Crawl risk of one loaded page, in hundredths; failed pages have none."""
    risk = F.greatest(
        F.when(F.col("has_password_field"), F.lit(R.CRAWL_POINTS["password"]))
        .when(F.col("has_login_form"), F.lit(R.CRAWL_POINTS["login"]))
        .otherwise(0),
        F.when(F.col("was_redirected"), F.lit(R.CRAWL_POINTS["redirect"])).otherwise(0),
    )
    return F.when(F.col("error").isNull(), risk).otherwise(0)


def page_facts(pages: DataFrame, as_of: str, max_flags: int | None = None) -> DataFrame:
    """One scored row per URL from stored page observations, newest first.

    visual_flags holds all flags of the page, or the first max_flags. The HTML is reduced to
    features before the shuffle by URL; pages that are page_rows already stay as they are.
    """
    if "visual_risk" in pages.columns:
        shown = leading(F.col("visual_flags"), max_flags).alias("visual_flags")
        compact = pages.select(*[shown if c == "visual_flags" else c for c in pages.columns])
    else:
        compact = page_rows(pages, max_flags)
    return latest(compact, "url", as_of)


def page_rows(pages: DataFrame, max_flags: int | None = None) -> DataFrame:
    """Stored pages as compact scored rows, without their HTML. Narrow."""
    scored = score_pages(page_features(pages)).withColumn("crawl_points", crawl_points())
    return scored.select(
        "url", "observed_at", *(["page_id"] if "page_id" in pages.columns else []),
        "error", "has_password_field", "has_login_form", "crawl_points",
        F.col("risk_score").alias("visual_risk"), "is_fake_login", "impersonated_brand",
        leading(F.col("flags"), max_flags).alias("visual_flags"),
    )


def rollup_pages(
    email_urls: DataFrame, facts: DataFrame, max_urls: int | None = None
) -> DataFrame:
    """Crawl and visual findings per email, over all its URLs or its first max_urls.

    email_urls: email_id, pos, url, take_screenshots. A URL without a stored page is not
    counted as crawled; failed pages count as crawled without risk.
    """
    wanted = email_urls if max_urls is None else email_urls.filter(F.col("pos") < max_urls)
    seen = wanted.join(facts, "url", "inner")
    return page_rollup(seen.groupBy("email_id"), F.lit(True))


def page_aggregates(crawled: Column) -> list[Column]:
    """Aggregates over rows with page facts; crawled says which rows count."""
    shown = crawled & F.col("take_screenshots") & F.col("error").isNull()
    fake = F.concat(
        F.array(
            F.concat(
                F.lit("Fake login page detected (impersonating "),
                F.coalesce("impersonated_brand", F.lit("unknown")),
                F.lit(")"),
            )
        ),
        F.col("visual_flags"),
    )
    crawl_note = F.when(
        crawled & F.col("error").isNull(),
        F.when(F.col("has_password_field"), F.lit("Password field detected on crawled page")).when(
            F.col("has_login_form"), F.lit("Login form detected on crawled page")
        ),
    )
    notes = F.sort_array(
        F.collect_list(
            F.when(
                crawled,
                F.struct(
                    F.col("pos"),
                    F.when(shown & F.col("is_fake_login"), fake).alias("fake"),
                    crawl_note.alias("note"),
                ),
            )
        )
    )
    return [
        F.count_if(crawled).alias("pages_crawled"),
        F.count_if(crawled & F.col("error").isNull()).alias("pages_loaded"),
        (F.max(F.when(crawled, F.col("crawl_points"))).cast("double") / 100.0).alias("crawl_risk"),
        F.count_if(shown).alias("pages_shown"),
        F.max(F.when(shown, F.col("visual_risk"))).alias("visual_risk"),
        F.flatten(
            F.filter(F.transform(notes, lambda n: n["fake"]), lambda f: f.isNotNull())
        ).alias("visual_factors"),
        F.array_compact(F.transform(notes, lambda n: n["note"])).alias("crawl_factors"),
    ]


def page_rollup(grouped, crawled: Column) -> DataFrame:
    return grouped.agg(*page_aggregates(crawled))
