"""Queries and check SQL: parsing, URL layer, enrichment joins, pages, redirect chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.curation import emails
from checks.duck import (
    EMAIL,
    EMAIL_URLS,
    PARSED,
    compact,
    ctes,
    domain,
    first_in,
    flags,
    hits,
    host,
    joined,
    latest,
    lst,
    points,
    q,
    score,
    shape,
    urls,
)
from mailsieve.functions import urls as U
from mailsieve.operators import links as L
from mailsieve.operators import pages as P
from mailsieve.operators import urls as O
from mailsieve.operators.parsing import merge_html_urls, parse_emails
from mailsieve.rules import links as LR
from mailsieve.rules import pages as PR
from mailsieve.rules import urls as R
from mailsieve.sources.derived import AS_OF, AS_OF_EPOCH, load_derived, load_table

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def bar(column) -> F.Column:
    return F.array_join(column, "|")


def big(column) -> F.Column:
    return F.col(column).cast("bigint").alias(column)


def parsed(spark, sf):
    return merge_html_urls(parse_emails(emails(spark, sf)))


@query("extract_urls", f"{ctes('emails')} SELECT email_id, {joined(urls('text'))} AS urls FROM emails")
def _extract(spark, sf):
    return emails(spark, sf).select("email_id", bar(U.extract_urls(F.col("text"))).alias("urls"))


@query(
    "extract_sender",
    f"{ctes('emails')} SELECT email_id, nullif(regexp_extract(text, '\\b{EMAIL}'), '') AS sender FROM emails",
)
def _sender(spark, sf):
    return emails(spark, sf).select("email_id", U.extract_sender(F.col("text")).alias("sender"))


@query("has_html", f"{ctes('emails')} SELECT email_id, regexp_matches(text, '<[^>]+>') AS has_html FROM emails")
def _html(spark, sf):
    return emails(spark, sf).select("email_id", U.has_html(F.col("text")).alias("has_html"))


@query("parse_emails", f"{ctes('emails')}, {PARSED} SELECT email_id, {joined('body_urls')} AS urls FROM parsed")
def _parse(spark, sf):
    return parse_emails(emails(spark, sf)).select("email_id", bar("urls").alias("urls"))


@query("merge_html_urls", f"{ctes('emails')}, {PARSED} SELECT email_id, {joined('urls')} AS urls FROM parsed")
def _merge(spark, sf):
    return parsed(spark, sf).select("email_id", bar("urls").alias("urls"))


@query(
    "explode_urls",
    f"{ctes('emails')}, {PARSED}, {EMAIL_URLS} SELECT email_id, pos, url, first_seen FROM email_urls",
)
def _explode(spark, sf):
    rows = O.explode_urls(parsed(spark, sf))
    return rows.select("email_id", big("pos"), "url", "first_seen")


@query(
    "url_parts",
    f"SELECT page_id, lower({shape('url', 1)}) AS scheme, {domain('url')} AS domain, {shape('url', 3)} AS path FROM pages",
)
def _parts(spark, sf):
    url = F.col("url")
    return load_table(spark, sf, "pages").select(
        "page_id",
        U.url_scheme(url).alias("scheme"),
        U.url_domain(url).alias("domain"),
        U.url_path(url).alias("path"),
    )


_TLD = "regexp_extract(d, '(" + "|".join(t.replace(".", "\\.") for t in R.SUSPICIOUS_TLDS) + ")$', 1)"
_DIGIT = first_in("d", sorted(R.LOOKALIKE_DIGITS))
_LETTER = "CASE " + " ".join(f"WHEN contains(d, {q(k)}) THEN {q(v)}" for k, v in sorted(R.LOOKALIKE_DIGITS.items())) + " END"
_DOTS = "length(d) - length(replace(d, '.', ''))"
_BRAND = first_in("d", sorted(R.IMPERSONATED_BRANDS))


def url_rule_sql(brand: str = _BRAND) -> list[tuple[str, str, str]]:
    p = R.POINTS
    return [
        ("regexp_full_match(d, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}')",
         "'URL uses IP address instead of domain name'", p["ip"]),
        (f"{_TLD} <> ''", f"'Suspicious TLD: ' || {_TLD}", p["tld"]),
        (f"{brand} IS NOT NULL", f"'Possible brand impersonation: ' || {brand}", p["brand"]),
        (f"{_DOTS} >= 3", f"'Excessive subdomains (' || ({_DOTS}) || ' dots)'", p["dots"]),
        ("length(url) > 200", "'Unusually long URL'", p["long"]),
        ("contains(url, '@')", "'URL contains @ symbol (possible redirection trick)'", p["at"]),
        (f"contains({shape('url', 3)}, '//')", "'Double slashes in URL path'", p["slashes"]),
        (f"{_DIGIT} IS NOT NULL",
         f"'Possible homograph: ''' || {_DIGIT} || ''' may substitute ''' || {_LETTER} || ''''", p["digit"]),
        (f"lower({shape('url', 1)}) = 'http'", "'Not using HTTPS'", p["http"]),
        ("age < 30", "'Very new domain (' || age || ' days old)'", p["new_domain"]),
        ("age >= 30 AND age < 180", "'Recently registered domain (' || age || ' days old)'", p["young_domain"]),
        ("ssl_valid AND days_left < 7", "'SSL certificate expiring in ' || days_left || ' days'", 0),
        ("NOT ssl_valid", "'Invalid SSL certificate'", p["bad_tls"]),
        ("malicious > 0", "'VirusTotal: ' || malicious || ' security vendors flagged as malicious'",
         "least(30, malicious * 5)"),
        ("suspicious > 0", "'VirusTotal: ' || suspicious || ' vendors flagged as suspicious'", 0),
    ]


def scored_urls(source: str, brand: str = _BRAND) -> str:
    """Scored rows of a relation with url, age, ssl_valid, days_left, malicious, suspicious."""
    rules = url_rule_sql(brand)
    h = host("url")
    bad = f"contains({h}, '[') <> contains({h}, ']')"
    fl = compact(flags([(c, f) for c, f, _ in rules]))
    pt = points([(c, p) for c, _, p in rules])
    return f"""(SELECT * REPLACE (CASE WHEN bad THEN 'unknown' ELSE domain END AS domain,
      CASE WHEN bad THEN ['Analysis error: Invalid IPv6 URL'] ELSE flags END AS flags,
      CASE WHEN bad THEN 0::DOUBLE ELSE risk_score END AS risk_score, (bad OR is_suspicious) AS is_suspicious)
    FROM (SELECT *, {fl} AS flags, {score(pt)} AS risk_score, ({pt}) >= 30 AS is_suspicious
      FROM (SELECT *, {domain('url')} AS domain, lower({domain('url')}) AS d, {bad} AS bad FROM ({source}))))"""


NO_FACTS = "NULL::BIGINT AS age, NULL::BOOLEAN AS ssl_valid, NULL::BIGINT AS days_left, NULL::BIGINT AS malicious, NULL::BIGINT AS suspicious"
RESULT = f"domain, risk_score, is_suspicious, {joined('flags')} AS flags"


def result(df, *keys):
    return df.select(*keys, "domain", "risk_score", "is_suspicious", bar("flags").alias("flags"))


@query("url_score", f"SELECT page_id, {RESULT} FROM {scored_urls(f'SELECT page_id, url, {NO_FACTS} FROM pages')}")
def _url_score(spark, sf):
    return result(O.score_url_table(load_table(spark, sf, "pages").select("page_id", "url")), "page_id")


@query(
    "email_url_score",
    f"""{ctes("emails")}, {PARSED}, {EMAIL_URLS} SELECT email_id, pos, {RESULT}
    FROM {scored_urls(f"SELECT email_id, pos, url, {NO_FACTS} FROM email_urls")}""",
)
def _email_url_score(spark, sf):
    rows = O.explode_urls(parsed(spark, sf))
    return result(O.score_urls(rows), "email_id", big("pos"))


_STRICT = "CASE " + " ".join(
    f"WHEN contains(d, {q(b)}) AND NOT ("
    + " OR ".join(
        [f"d = {q(x)} OR ends_with(d, {q('.' + x)})" for x in R.LEGITIMATE_DOMAINS.get(b, [])] or ["FALSE"]
    )
    + f") THEN {q(b)}"
    for b in sorted(R.IMPERSONATED_BRANDS)
) + " END"


@query(
    "url_score_strict_brands",
    f"""{ctes("emails")}, {PARSED}, {EMAIL_URLS} SELECT email_id, pos, {RESULT}
    FROM {scored_urls(f"SELECT email_id, pos, url, {NO_FACTS} FROM email_urls", _STRICT)}""",
)
def _strict(spark, sf):
    return result(O.score_urls(O.explode_urls(parsed(spark, sf)), True), "email_id", big("pos"))


URL_FLAGS_BY_HIT = f"""SELECT f.flag, count(*) AS urls FROM (SELECT unnest(flags) AS flag
  FROM {scored_urls(f'SELECT url, {NO_FACTS} FROM pages')}) f GROUP BY f.flag"""


@query("url_flags", URL_FLAGS_BY_HIT)
def _flags(spark, sf):
    scored = O.score_urls(load_table(spark, sf, "pages").select("url"))
    exploded = scored.select(F.explode_outer("flags").alias("flag")).filter(F.col("flag").isNotNull())
    return exploded.groupBy("flag").agg(F.count(F.lit(1)).alias("urls"))


FACTS = f"""dom AS (SELECT coalesce(r.domain, t.domain) AS domain,
    CAST(floor(({AS_OF_EPOCH} - r.creation_epoch) / 86400) AS BIGINT) AS age, r.registrar, t.ssl_valid, t.ssl_issuer,
    CAST(floor((t.not_after_epoch - {AS_OF_EPOCH}) / 86400) AS BIGINT) AS days_left
  FROM {latest('domain_registry', 'domain')} r FULL JOIN {latest('tls_observations', 'domain')} t ON r.domain = t.domain),
  rep AS (SELECT url, malicious, suspicious, harmless FROM {latest('url_reputation', 'url')})"""
ENRICHED = f"""enriched AS (SELECT e.*, dom.age, dom.registrar, dom.ssl_valid, dom.ssl_issuer, dom.days_left, rep.malicious, rep.suspicious
  FROM (SELECT *, {domain('url')} AS dk FROM email_urls) e LEFT JOIN dom ON e.dk = dom.domain LEFT JOIN rep ON e.url = rep.url)"""
DERIVED = ctes("emails", "domain_registry", "tls_observations", "url_reputation")


def evidence(spark, sf):
    names = ("domain_registry", "tls_observations", "url_reputation")
    return [load_derived(spark, sf, n) for n in names]


def enriched(spark, sf):
    return O.enrich_urls(O.explode_urls(parsed(spark, sf)), *evidence(spark, sf), as_of=AS_OF)


@query(
    "enrich_urls",
    f"""{DERIVED}, {PARSED}, {EMAIL_URLS}, {FACTS}, {ENRICHED} SELECT email_id, pos, url, age AS domain_age_days, registrar,
    ssl_valid, ssl_issuer, days_left AS ssl_days_left, malicious AS vt_malicious, suspicious AS vt_suspicious FROM enriched""",
)
def _enrich(spark, sf):
    return enriched(spark, sf).select(
        "email_id", big("pos"), "url", big("domain_age_days"), "registrar", "ssl_valid", "ssl_issuer",
        big("ssl_days_left"), "vt_malicious", "vt_suspicious",
    )


@query(
    "enrich_urls_at",
    f"""{DERIVED}, {PARSED}, {EMAIL_URLS},
    reg AS (SELECT domain, observed_epoch, max({{'c': creation_epoch, 'g': registrar}}) AS f FROM domain_registry GROUP BY ALL),
    crt AS (SELECT domain, observed_epoch, max({{'v': ssl_valid, 'i': ssl_issuer, 'n': not_after_epoch}}) AS f FROM
      (SELECT *, row_number() OVER (PARTITION BY domain, observed_epoch ORDER BY ssl_valid DESC NULLS LAST, ssl_issuer DESC NULLS LAST, not_after_epoch DESC NULLS LAST) AS no FROM tls_observations)
      WHERE no = 1 GROUP BY ALL),
    mail_at AS (SELECT e.email_id, pos, e.url, {domain('e.url')} AS dk, received_epoch FROM email_urls e JOIN emails USING (email_id))
    SELECT email_id, pos, url, CAST(floor((received_epoch - reg.f.c) / 86400) AS BIGINT) AS domain_age_days, reg.f.g AS registrar,
      crt.f.v AS ssl_valid, crt.f.i AS ssl_issuer, CAST(floor((crt.f.n - received_epoch) / 86400) AS BIGINT) AS ssl_days_left
    FROM mail_at ASOF LEFT JOIN reg ON dk = reg.domain AND received_epoch >= reg.observed_epoch
    ASOF LEFT JOIN crt ON dk = crt.domain AND received_epoch >= crt.observed_epoch""",
)
def _enrich_at(spark, sf):
    """Domain facts at the time of each mail."""
    mails = parsed(spark, sf)
    rows = O.explode_urls(mails).join(emails(spark, sf).select("email_id", "received_at"), "email_id")
    registry, tls, _ = evidence(spark, sf)
    return O.enrich_urls_at(rows, registry, tls).select(
        "email_id", big("pos"), "url", big("domain_age_days"), "registrar", "ssl_valid", "ssl_issuer", big("ssl_days_left")
    )


@query(
    "url_score_enriched",
    f"{DERIVED}, {PARSED}, {EMAIL_URLS}, {FACTS}, {ENRICHED} SELECT email_id, pos, {RESULT} FROM {scored_urls('SELECT * FROM enriched')}",
)
def _scored(spark, sf):
    return result(O.score_urls(enriched(spark, sf)), "email_id", big("pos"))


def rollup_sql(cut: str = "") -> str:
    return f"""{DERIVED}, {PARSED}, {EMAIL_URLS}, {FACTS}, {ENRICHED}, sc AS (SELECT * FROM {scored_urls("SELECT * FROM enriched")})
    SELECT email_id, count(*) AS total_urls, count(*) FILTER (WHERE is_suspicious) AS suspicious_count, max(risk_score) AS highest_risk,
    coalesce(array_to_string(flatten(list(flags{cut} ORDER BY pos) FILTER (WHERE is_suspicious)), '|'), '') AS risk_factors
    FROM sc GROUP BY email_id"""


@query("url_rollup", rollup_sql())
def _rollup(spark, sf):
    out = O.rollup_urls(O.score_urls(enriched(spark, sf)))
    return out.withColumn("risk_factors", bar("risk_factors"))


@query("url_rollup_top3", rollup_sql("[1:3]"))
def _rollup3(spark, sf):
    out = O.rollup_urls(O.score_urls(enriched(spark, sf)), 3)
    return out.withColumn("risk_factors", bar("risk_factors"))


# Pages. Tags and attributes are taken with the same plain patterns.
def attr(tag: str, name: str) -> str:
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))"""
    return " || ".join(f"regexp_extract({tag}, '{pattern}', {g})" for g in (1, 2, 3))


def unescape(expr: str) -> str:
    for entity, char in P.ENTITIES:
        expr = f"replace({expr}, {q(entity)}, {q(char)})"
    return expr


def squeeze(expr: str) -> str:
    from checks.duck import S

    return f"trim(regexp_replace({expr}, '{S}+', ' ', 'g'))"


_INPUT = r"(?is)<input(?:\s[^>]*|/)?>"
_HAS_LOGIN = " OR ".join(f"contains(lower(i), {q(k)})" for k in PR.LOGIN_FIELD_WORDS)
_TYPE = f"CASE WHEN ({attr('i', 'type')}) = '' THEN 'text' ELSE {attr('i', 'type')} END"
FEATURES = rf"""loaded AS (SELECT * REPLACE (CASE WHEN final_url <> '' AND final_url <> 'about:blank' AND status_code IS NOT NULL THEN html ELSE '' END AS html),
    coalesce(final_url <> '' AND final_url <> 'about:blank' AND status_code IS NOT NULL, FALSE) AS ok FROM crawled_pages),
  tags AS (SELECT *, regexp_extract_all(html, '(?is)<form(?:\s[^>]*)?>.*?(?:</form\s*>|\z)') AS forms,
    regexp_extract_all(html, '{_INPUT}') AS inputs,
    list_filter(regexp_extract_all(html, '(?is)<a\s[^>]*>'), lambda a: regexp_matches(a, '(?is)\shref\s*=')) AS anchors FROM loaded),
  f1 AS (SELECT *, {squeeze(unescape("regexp_extract(html, '(?is)<title(?:" + chr(92) + "s[^>]*)?>(.*?)</title', 1)"))} AS page_title,
    {squeeze(unescape("regexp_replace(html, '" + P.NOT_SHOWN + "', ' ', 'g')"))} AS page_text,
    list_transform(forms, lambda f: {attr("regexp_extract(f, '(?s)^<[^>]*>')", "action")}) AS form_actions,
    list_transform(flatten(list_transform(forms, lambda f: regexp_extract_all(f, '{_INPUT}'))),
      lambda i: {_TYPE} || ':' || {attr("i", "name")}) AS input_fields,
    len(list_filter(inputs, lambda i: lower({attr("i", "type")}) = 'password')) > 0 AS has_password_field,
    list_filter(list_transform(anchors, lambda a: {attr("a", "href")}),
      lambda h: starts_with(h, 'http') AND {host("h")} <> {host("final_url")}) AS external_links,
    ok AND final_url <> url AS was_redirected FROM tags),
  features AS (SELECT *, has_password_field OR len(list_filter(input_fields, lambda i: {_HAS_LOGIN})) > 0 AS has_login_form FROM f1)"""
PAGES = ctes("crawled_pages")


def features(spark, sf):
    return P.page_features(load_derived(spark, sf, "crawled_pages"))


@query(
    "page_features",
    f"""{PAGES}, {FEATURES} SELECT page_id, page_title, page_text, {joined("form_actions")} AS form_actions,
    {joined("input_fields")} AS input_fields, has_password_field, has_login_form, was_redirected FROM features""",
)
def _features(spark, sf):
    return features(spark, sf).select(
        "page_id", "page_title", "page_text", bar("form_actions").alias("form_actions"),
        bar("input_fields").alias("input_fields"), "has_password_field", "has_login_form", "was_redirected",
    )


@query(
    "page_title",
    rf"""SELECT page_id, {squeeze(unescape("regexp_extract(html, '(?is)<title(?:" + chr(92) + "s[^>]*)?>(.*?)</title', 1)"))} AS page_title FROM pages""",
)
def _title(spark, sf):
    stored = load_table(spark, sf, "pages").withColumns(
        {"final_url": F.col("url"), "status_code": F.lit(200), "error": F.lit(None).cast("string")}
    )
    return P.page_features(stored).select("page_id", "page_title")


@query(
    "page_external_links",
    f"{PAGES}, {FEATURES} SELECT page_id, {joined('external_links')} AS external_links FROM features",
)
def _external(spark, sf):
    return features(spark, sf).select("page_id", bar("external_links").alias("external_links"))


def _own(domains) -> str:
    return "(" + " OR ".join(f"d = {q(x)} OR ends_with(d, {q('.' + x)})" for x in domains) + ")"


def _title_sql(b: str) -> str:
    return f"upper(left({q(b)}, 1)) || {q(b[1:])}"


_BRAND_HITS = ", ".join(
    f"CASE WHEN len({hits('t', titles)}) + len({hits('x', words)}) >= 2 AND NOT {_own(own)} THEN {q(b)} END"
    for b, (titles, words, own) in PR.BRAND_PAGES.items()
)
_TITLE_HITS = ", ".join(
    f"CASE WHEN len({hits('t', titles)}) > 0 AND NOT {_own(own)} AND has_login_form THEN {q(b)} END"
    for b, (titles, words, own) in PR.BRAND_PAGES.items()
)
_CRED = " OR ".join(f"contains(lower(i), {q(k)})" for k in PR.CREDENTIAL_FIELD_WORDS)
_CAP = "upper(left(b, 1)) || substr(b, 2)"
SCORED_PAGES = f"""p1 AS (SELECT *, {host("CASE WHEN final_url <> '' THEN final_url ELSE url END")} AS h, lower(page_title) AS t, lower(page_text) AS x,
    {host("url")} AS h0, {host("final_url")} AS h1 FROM features),
  p2 AS (SELECT *, lower(h) AS d FROM p1),
  p3 AS (SELECT *, {compact(f"[{_BRAND_HITS}]")} AS brands, {compact(f"[{_TITLE_HITS}]")} AS tbrands,
    list_filter(list_transform(list_filter(form_actions, lambda a: starts_with(a, 'http')), lambda a: {host("a")}), lambda z: z <> h) AS fh,
    list_filter(input_fields, lambda i: {_CRED}) AS cred, {hits("x", PR.URGENCY_PHRASES)} AS urg, {hits("x", PR.SENSITIVE_PHRASES)} AS sens,
    len(list_filter(string_split(redirect_path, '|'), lambda z: z <> '')) AS hops FROM p2),
  p4 AS (SELECT *,
    list_concat(list_concat(list_concat(list_transform(brands, lambda b: 'Page impersonates ' || {_CAP} || ' but hosted on ' || d),
      list_transform(fh, lambda z: 'Form submits data to external domain: ' || z)),
      {compact("[CASE WHEN len(cred) >= 2 THEN 'Multiple credential input fields: ' || array_to_string(cred[1:5], ', ') END, CASE WHEN len(urg) > 0 THEN 'Urgency language detected: ' || array_to_string(urg[1:3], ', ') END, CASE WHEN len(sens) > 0 THEN 'Requests sensitive data: ' || array_to_string(sens[1:3], ', ') END]")}),
      list_concat(list_transform(tbrands, lambda b: 'Login page title suggests ' || {_CAP} || ' but domain is ' || d),
      {compact("[CASE WHEN was_redirected AND h0 <> h1 THEN 'Redirected to different domain: ' || h0 || ' → ' || h1 END, CASE WHEN was_redirected AND hops > 3 THEN 'Multiple redirects (' || hops || ' hops)' END]")})) AS flags,
    CASE WHEN len(brands) > 0 THEN 35 ELSE 0 END + CASE WHEN has_password_field AND has_login_form THEN 20 WHEN has_password_field THEN 10 ELSE 0 END
      + 15 * len(brands) + 15 * len(fh) + CASE WHEN len(cred) >= 2 THEN 15 ELSE 0 END + CASE WHEN len(urg) > 0 THEN 10 ELSE 0 END
      + CASE WHEN len(sens) > 0 THEN 15 ELSE 0 END + CASE WHEN was_redirected AND h0 <> h1 THEN 10 ELSE 0 END
      + CASE WHEN was_redirected AND hops > 3 THEN 5 ELSE 0 END AS pts FROM p3),
  scored_pages AS (SELECT *, {score("pts")} AS risk_score, pts >= 40 AS is_fake_login, brands[-1] AS impersonated_brand,
    CASE WHEN error IS NOT NULL THEN 0 ELSE greatest(CASE WHEN has_password_field THEN 70 WHEN has_login_form THEN 50 ELSE 0 END,
      CASE WHEN was_redirected THEN 30 ELSE 0 END) END AS crawl_points FROM p4)"""


def scored_pages(spark, sf):
    return P.score_pages(features(spark, sf))


@query(
    "page_score",
    f"""{PAGES}, {FEATURES}, {SCORED_PAGES} SELECT page_id, risk_score, is_fake_login, impersonated_brand, {joined("flags")} AS flags FROM scored_pages""",
)
def _page_score(spark, sf):
    return scored_pages(spark, sf).select(
        "page_id", "risk_score", "is_fake_login", "impersonated_brand", bar("flags").alias("flags")
    )


@query("page_brand", f"{PAGES}, {FEATURES}, {SCORED_PAGES} SELECT page_id, {joined('brands')} AS brands FROM scored_pages")
def _brand(spark, sf):
    return scored_pages(spark, sf).select("page_id", bar("brand_matches").alias("brands"))


@query("crawl_risk", f"{PAGES}, {FEATURES}, {SCORED_PAGES} SELECT page_id, crawl_points::BIGINT AS crawl_points FROM scored_pages")
def _crawl(spark, sf):
    return features(spark, sf).select("page_id", P.crawl_points().cast("bigint").alias("crawl_points"))


PAGE_FACTS = f"""page_facts AS (SELECT * FROM {latest("scored_pages", "url")})"""
MAIL_PAGES = f"""{ctes("emails", "crawled_pages")}, {PARSED}, {EMAIL_URLS}, {FEATURES}, {SCORED_PAGES}, {PAGE_FACTS},
  seen AS (SELECT e.email_id, e.pos, e.take_screenshots, e.take_screenshots AND f.error IS NULL AS shown, f.* EXCLUDE (url, page_id)
    FROM email_urls e JOIN page_facts f ON e.url = f.url)"""
PAGE_AGG = """count(*) AS pages_crawled, count(*) FILTER (WHERE error IS NULL) AS pages_loaded, max(crawl_points)::DOUBLE / 100.0::DOUBLE AS crawl_risk,
    count(*) FILTER (WHERE shown) AS pages_shown, max(risk_score) FILTER (WHERE shown) AS visual_risk,
    coalesce(array_to_string(flatten(list(list_concat(['Fake login page detected (impersonating ' || coalesce(impersonated_brand, 'unknown') || ')'], flags) ORDER BY pos)
      FILTER (WHERE shown AND is_fake_login)), '|'), '') AS visual_factors,
    coalesce(array_to_string(list(CASE WHEN has_password_field THEN 'Password field detected on crawled page' ELSE 'Login form detected on crawled page' END ORDER BY pos)
      FILTER (WHERE error IS NULL AND (has_password_field OR has_login_form)), '|'), '') AS crawl_factors"""


@query("page_rollup", f"{MAIL_PAGES} SELECT email_id, {PAGE_AGG} FROM seen GROUP BY email_id")
def _page_rollup(spark, sf):
    facts = P.page_facts(load_derived(spark, sf, "crawled_pages"), AS_OF)
    mails = parsed(spark, sf)
    switches = mails.select("email_id", "take_screenshots")
    rows = O.explode_urls(mails).join(switches, "email_id")
    out = P.rollup_pages(rows, facts)
    return out.withColumns({c: bar(c) for c in ("visual_factors", "crawl_factors")})


_FINAL_TLD = "regexp_extract(h1, '(" + "|".join(t.replace(".", "\\.") for t in LR.FINAL_TLDS) + ")$', 1)"
CHAINS = f"""hop AS (SELECT DISTINCT url, hop_no, hop_url, status, timed_out FROM link_hops),
  chain0 AS (SELECT url, max(hop_no) AS n, arg_max(hop_url, hop_no) AS last_url, arg_max(status, hop_no) AS code, bool_or(timed_out) AS timed_out,
    list(hop_url ORDER BY hop_no) AS path FROM hop GROUP BY url),
  chains AS (SELECT url, CASE WHEN NOT timed_out AND code IS NOT NULL THEN last_url ELSE '' END AS final_url, code AS status_code,
    CASE WHEN NOT timed_out AND code IS NOT NULL THEN n ELSE 0 END AS redirect_count,
    CASE WHEN NOT timed_out AND code IS NOT NULL AND n > 0 THEN path ELSE []::VARCHAR[] END AS redirect_chain, timed_out FROM chain0)"""
_LINK_RULES = [
    ("timed_out", q(L.TIMED_OUT)),
    ("final_url <> '' AND redirect_count > 0 AND h0 <> h1", "'Redirect changes domain: ' || h0 || ' → ' || h1"),
    ("final_url <> '' AND redirect_count > 3", "'Excessive redirects (' || redirect_count || ' hops)'"),
    (f"final_url <> '' AND list_contains({lst(LR.SHORTENERS)}, h0)", "'URL shortener used: ' || h0"),
    (f"final_url <> '' AND {_FINAL_TLD} <> ''", f"'Final destination has suspicious TLD: ' || {_FINAL_TLD}"),
    ("starts_with(final_url, 'http://')", "'Final destination uses insecure HTTP'"),
    ("final_url <> '' AND redirect_count > 0 AND starts_with(url, 'https:') AND starts_with(final_url, 'http:')",
     "'Downgraded from HTTPS to HTTP during redirect'"),
]
SCORED_LINKS = f"""links AS (SELECT *, {compact(flags(_LINK_RULES))} AS flags,
    {" OR ".join(f"coalesce({c}, FALSE)" for i, (c, _) in enumerate(_LINK_RULES) if i != 5)} AS is_suspicious
  FROM (SELECT *, {host("url")} AS h0, {host("final_url")} AS h1 FROM chains))"""


@query(
    "link_chain",
    f"""{ctes("link_hops")}, {CHAINS} SELECT url, final_url, status_code, redirect_count, {joined("redirect_chain")} AS redirect_chain, timed_out FROM chains""",
)
def _chain(spark, sf):
    out = L.link_chains(load_derived(spark, sf, "link_hops"))
    return out.withColumn("redirect_chain", bar("redirect_chain"))


@query("link_flags", f"{ctes('link_hops')}, {CHAINS}, {SCORED_LINKS} SELECT url, is_suspicious, {joined('flags')} AS flags FROM links")
def _link_flags(spark, sf):
    out = L.score_links(L.link_chains(load_derived(spark, sf, "link_hops")))
    return out.select("url", "is_suspicious", bar("flags").alias("flags"))


LINK_AGG = """count(*) AS checked_links, count(*) FILTER (WHERE l.is_suspicious) AS suspicious_links,
    coalesce(flatten(list(l.flags ORDER BY pos) FILTER (WHERE l.is_suspicious)), []::VARCHAR[]) AS link_flags"""
LINK_SCORE = "least(1.0::DOUBLE, suspicious_links::DOUBLE / checked_links::DOUBLE * 0.5::DOUBLE + len(link_flags) * 0.05::DOUBLE)"


@query(
    "link_score",
    f"""{ctes("emails", "link_hops")}, {PARSED}, {EMAIL_URLS}, {CHAINS}, {SCORED_LINKS}, a AS (SELECT email_id, {LINK_AGG}
      FROM email_urls e LEFT JOIN links l ON e.url = l.url WHERE first_seen GROUP BY email_id)
    SELECT email_id, checked_links, suspicious_links, {joined("link_flags")} AS link_flags, {LINK_SCORE} AS risk_score FROM a""",
)
def _link_score(spark, sf):
    scored = L.score_links(L.link_chains(load_derived(spark, sf, "link_hops")))
    out = L.rollup_links(O.explode_urls(parsed(spark, sf)), scored)
    return out.withColumn("link_flags", bar("link_flags"))
