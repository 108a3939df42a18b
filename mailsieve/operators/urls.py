"""URL layer: explode, enrich, score, roll up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.functions import urls as U
from mailsieve.operators.asof import newest_before
from mailsieve.functions.columns import (
    Rule,
    contained,
    contains_any,
    ending,
    first_contained,
    flags_of,
    in_domains,
    leading,
    points_of,
    score_of,
)
from mailsieve.rules import urls as R

ENRICHMENT = {
    "domain_age_days": "int",
    "registrar": "string",
    "ssl_valid": "boolean",
    "ssl_issuer": "string",
    "ssl_days_left": "int",
    "vt_malicious": "bigint",
    "vt_suspicious": "bigint",
    "vt_harmless": "bigint",
}


def explode_urls(df: DataFrame, first: int | None = None) -> DataFrame:
    """One row per URL: email_id, pos (from 0), url, first_seen.

    first keeps the leading URLs of each email, as the crawl and link checks do.
    """
    urls = F.col("urls") if first is None else F.slice("urls", 1, first)
    placed = F.transform(
        urls,
        lambda u, i: F.struct(
            i.alias("pos"),
            u.alias("url"),
            (F.array_position(F.col("urls"), u) == i + 1).alias("first_seen"),
        ),
    )
    # The outer form keeps the URLs from being extracted again for a size filter.
    return df.select("email_id", F.inline_outer(placed)).filter(F.col("url").isNotNull())


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days, rounded down."""
    return F.floor((F.unix_seconds(later) - F.unix_seconds(earlier)) / 86400).cast("int")


def latest(df: DataFrame, key: str, as_of: str) -> DataFrame:
    """Newest observation per key not after as_of; ties go by the other columns in order.

    A plain aggregation, so a key observed over and over is combined before the shuffle.
    """
    rest = [c for c in df.columns if c not in (key, "observed_at")]
    return (
        df.filter(F.col("observed_at") <= F.lit(as_of).cast("timestamp"))
        .groupBy(key)
        .agg(F.max(F.struct("observed_at", *rest)).alias("_newest"))
        .select(key, *[F.col(f"_newest.{c}").alias(c) for c in rest])
    )


def domain_facts(
    registry: DataFrame | None, tls: DataFrame | None, as_of: str
) -> DataFrame | None:
    """Age, registrar and certificate state per domain as of a moment."""
    now = F.lit(as_of).cast("timestamp")
    parts = []
    if registry is not None:
        age = days_between(now, F.col("creation_at")).alias("domain_age_days")
        parts.append(latest(registry, "domain", as_of).select("domain", age, "registrar"))
    if tls is not None:
        left = days_between(F.col("not_after_at"), now).alias("ssl_days_left")
        parts.append(latest(tls, "domain", as_of).select("domain", "ssl_valid", "ssl_issuer", left))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].join(parts[1], "domain", "full")


def reputation_facts(reputation: DataFrame, as_of: str) -> DataFrame:
    """Newest vendor counts per URL."""
    return latest(reputation, "url", as_of).select(
        "url",
        F.col("malicious").alias("vt_malicious"),
        F.col("suspicious").alias("vt_suspicious"),
        F.col("harmless").alias("vt_harmless"),
    )


def enrich_urls(
    urls: DataFrame,
    registry: DataFrame | None = None,
    tls: DataFrame | None = None,
    reputation: DataFrame | None = None,
    as_of: str = "",
) -> DataFrame:
    """Left-join the newest domain and reputation facts to URL rows.

    The facts have one row per key; the URL rows stay on the left, where a hot domain or
    URL is split by the adaptive skew join.
    """
    out = urls
    domains = domain_facts(registry, tls, as_of)
    if domains is not None:
        keyed = out.withColumn("domain", U.url_domain(F.col("url")))
        out = keyed.join(domains, "domain", "left").drop("domain")
    if reputation is not None:
        out = out.join(reputation_facts(reputation, as_of), "url", "left")
    return out


def enrich_urls_at(urls: DataFrame, registry: DataFrame | None = None, tls: DataFrame | None = None, at: str = "received_at") -> DataFrame:
    """Domain facts as they were known when each mail came: URL rows carry its time.

    Ages and the days a certificate has left are measured at that time too.
    """
    out = urls.withColumn("_domain", U.url_domain(F.col("url")))
    when = F.col(at)
    if registry is not None:
        known = registry.select(F.col("domain").alias("_domain"), "observed_at", "creation_at", "registrar")
        out = newest_before(out, known, "_domain", at, out="_known")
        age = days_between(when, F.col("_known.creation_at"))
        out = out.withColumn("domain_age_days", age).withColumn("registrar", F.col("_known.registrar")).drop("_known")
    if tls is not None:
        known = tls.select(F.col("domain").alias("_domain"), "observed_at", "ssl_valid", "ssl_issuer", "not_after_at")
        out = newest_before(out, known, "_domain", at, out="_known")
        left = days_between(F.col("_known.not_after_at"), when)
        out = out.withColumns({"ssl_valid": F.col("_known.ssl_valid"), "ssl_issuer": F.col("_known.ssl_issuer"), "ssl_days_left": left}).drop("_known")
    return out.drop("_domain")


def brand_in_domain(domain: Column, strict: bool = False) -> Column:
    """Alphabetically first brand inside the domain; strict spares a brand's own domains."""
    brands = sorted(R.IMPERSONATED_BRANDS)
    if not strict:
        return first_contained(domain, brands)
    spared = [
        F.when(in_domains(domain, own), F.lit(brand))
        for brand, own in R.LEGITIMATE_DOMAINS.items()
    ]
    found = F.array_except(contained(domain, brands), F.array_compact(F.array(*spared)))
    return F.get(found, F.lit(0))


def url_rules(strict_brands: bool = False) -> list[Rule]:
    """Rules over the columns url, _domain, _path, _scheme and the enrichment columns."""
    domain = F.col("_domain")
    url = F.col("url")
    points = R.POINTS
    tld = ending(domain, R.SUSPICIOUS_TLDS)
    brand = brand_in_domain(domain, strict_brands)
    digits = sorted(R.LOOKALIKE_DIGITS)
    digit = first_contained(domain, digits)
    letter = F.translate(digit, "".join(digits), "".join(R.LOOKALIKE_DIGITS[d] for d in digits))
    dots = F.regexp_count(domain, F.lit(r"\."))
    age = F.col("domain_age_days")
    left = F.col("ssl_days_left")
    malicious = F.col("vt_malicious")
    doubtful = F.col("vt_suspicious")
    return [
        Rule(
            F.rlike(domain, F.lit(r"^\p{Nd}{1,3}(?:\.\p{Nd}{1,3}){3}\z")),
            "URL uses IP address instead of domain name",
            points["ip"],
        ),
        Rule(tld != "", F.concat(F.lit("Suspicious TLD: "), tld), points["tld"]),
        Rule(
            brand.isNotNull(),
            F.concat(F.lit("Possible brand impersonation: "), brand),
            points["brand"],
        ),
        Rule(
            dots >= R.MANY_DOTS,
            F.format_string("Excessive subdomains (%d dots)", dots),
            points["dots"],
        ),
        Rule(F.char_length(url) > R.LONG_URL, "Unusually long URL", points["long"]),
        Rule(
            F.contains(url, F.lit("@")),
            "URL contains @ symbol (possible redirection trick)",
            points["at"],
        ),
        Rule(
            F.contains(F.col("_path"), F.lit("//")),
            "Double slashes in URL path",
            points["slashes"],
        ),
        Rule(
            contains_any(domain, digits),
            F.format_string("Possible homograph: '%s' may substitute '%s'", digit, letter),
            points["digit"],
        ),
        Rule(F.col("_scheme") == "http", "Not using HTTPS", points["http"]),
        Rule(
            age < R.NEW_DOMAIN_DAYS,
            F.format_string("Very new domain (%d days old)", age),
            points["new_domain"],
        ),
        Rule(
            (age >= R.NEW_DOMAIN_DAYS) & (age < R.YOUNG_DOMAIN_DAYS),
            F.format_string("Recently registered domain (%d days old)", age),
            points["young_domain"],
        ),
        Rule(
            F.col("ssl_valid") & (left < R.CERTIFICATE_WARNING_DAYS),
            F.format_string("SSL certificate expiring in %d days", left),
        ),
        Rule(~F.col("ssl_valid"), "Invalid SSL certificate", points["bad_tls"]),
        Rule(
            malicious > 0,
            F.format_string("VirusTotal: %d security vendors flagged as malicious", malicious),
            F.least(F.lit(points["vendors_max"]), malicious * points["per_vendor"]),
        ),
        Rule(
            doubtful > 0,
            F.format_string("VirusTotal: %d vendors flagged as suspicious", doubtful),
        ),
    ]


def score_urls(df: DataFrame, strict_brands: bool = False) -> DataFrame:
    """Add domain, flags, risk_score and is_suspicious to rows with a url column.

    Narrow: no shuffle. Missing enrichment columns count as unknown.
    """
    missing = {
        name: F.lit(None).cast(kind)
        for name, kind in ENRICHMENT.items()
        if name not in df.columns
    }
    url = F.col("url")
    parts = df.withColumns(
        {
            **missing,
            "domain": U.url_domain(url),
            "_path": U.url_path(url),
            "_scheme": U.url_scheme(url),
            "_malformed": U.is_malformed(url),
        }
    ).withColumn("_domain", F.lower("domain"))
    rules = url_rules(strict_brands)
    scored = parts.withColumns({"_flags": flags_of(rules), "_points": points_of(rules)})
    broken = F.col("_malformed")
    error = F.array(F.lit("Analysis error: Invalid IPv6 URL"))
    return scored.withColumns(
        {
            "domain": F.when(broken, F.lit("unknown")).otherwise(F.col("domain")),
            "flags": F.when(broken, error).otherwise(F.col("_flags")),
            "risk_score": F.when(broken, F.lit(0.0)).otherwise(score_of(F.col("_points"))),
            "is_suspicious": broken | (F.col("_points") >= R.SUSPICIOUS_AT),
        }
    ).drop("_path", "_scheme", "_malformed", "_domain", "_flags", "_points")


def rollup_urls(findings: DataFrame, top_flags: int | None = None) -> DataFrame:
    """One row per email: URL count, suspicious count, highest risk, flags.

    All flags of each suspicious URL are given, or its first top_flags.

    An email holds the URLs of one message only, so its collected list is small.
    """
    factor = F.when(F.col("is_suspicious"), leading(F.col("flags"), top_flags))
    in_order = F.sort_array(F.collect_list(F.struct("pos", factor.alias("f"))))
    return findings.groupBy("email_id").agg(
        F.count(F.lit(1)).alias("total_urls"),
        F.count_if("is_suspicious").alias("suspicious_count"),
        F.max("risk_score").alias("highest_risk"),
        F.flatten(
            F.filter(F.transform(in_order, lambda x: x["f"]), lambda f: f.isNotNull())
        ).alias("risk_factors"),
    )


def score_url_table(
    df: DataFrame,
    registry: DataFrame | None = None,
    tls: DataFrame | None = None,
    reputation: DataFrame | None = None,
    as_of: str = "",
    strict_brands: bool = False,
) -> DataFrame:
    """Score a table of URLs, with whatever enrichment tables are at hand."""
    return score_urls(enrich_urls(df, registry, tls, reputation, as_of), strict_brands)
