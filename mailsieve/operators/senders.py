"""Sender layer: metadata mismatches, spoofed names, look-alike domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.functions.columns import (
    Rule,
    first_contained,
    flags_of,
    in_set,
    points_of,
    score_of,
    text_array,
    with_value,
)
from mailsieve.functions.text import strip
from mailsieve.rules import senders as R

FIELDS = ["from_name", "from_email", "mailed_by", "signed_by", "security"]
NAME_ADDRESS = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"


def _unrelated(domain: Column, other: Column) -> Column:
    """True if the domains differ and none is below the other."""
    return (
        (other != "")
        & (other != domain)
        & ~F.endswith(other, F.concat(F.lit("."), domain))
        & ~F.endswith(domain, F.concat(F.lit("."), other))
    )


def lookalike_brand(base: Column) -> Column:
    """Alphabetically first brand the domain label resembles, or NULL.

    One or two different letters at equal length, or equal after the replacements.
    """
    plain = base
    for fake, real in R.LOOKALIKE_STEPS:
        plain = F.replace(plain, F.lit(fake), F.lit(real))

    def differing(label: Column, brand: Column) -> Column:
        places = F.sequence(F.lit(1), F.char_length(brand))
        return F.size(
            F.filter(places, lambda i: F.substr(label, i, F.lit(1)) != F.substr(brand, i, F.lit(1)))
        )

    def resembles(label: Column, swapped: Column, brand: Column) -> Column:
        close = F.when(
            F.char_length(brand) == F.char_length(label), differing(label, brand).between(1, 2)
        ).otherwise(False)
        return (brand != label) & (close | ((swapped == brand) & (swapped != label)))

    brands = text_array(sorted(R.BRANDS))
    alike = with_value(
        F.struct(base.alias("label"), plain.alias("swapped")),
        lambda x: F.filter(brands, lambda b: resembles(x["label"], x["swapped"], b)),
    )
    return F.get(alike, F.lit(0))


def score_senders(df: DataFrame) -> DataFrame:
    """Add a struct column ``sender_check`` from the sender fields. Narrow.

    NULL when all sender fields are NULL (no metadata given).
    """
    email = F.lower(strip(F.coalesce("from_email", F.lit(""))))
    base = df.withColumns(
        {
            "_domain": strip(F.substring_index(email, "@", -1)),
            "_name": strip(F.coalesce("from_name", F.lit(""))),
            "_mailed": F.lower(strip(F.coalesce("mailed_by", F.lit("")))),
            "_signed": F.lower(strip(F.coalesce("signed_by", F.lit("")))),
            "_security": F.lower(strip(F.coalesce("security", F.lit("")))),
        }
    )
    found = base.withColumns(
        {
            "_free": in_set(F.col("_domain"), R.FREE_PROVIDERS),
            "_brand": first_contained(
                F.replace(F.lower("_name"), F.lit(" "), F.lit("")), sorted(R.BRANDS)
            ),
            "_others": F.filter(
                F.transform(
                    F.regexp_extract_all("_name", F.lit(NAME_ADDRESS), F.lit(0)),
                    lambda a: F.lower(F.substring_index(a, "@", -1)),
                ),
                lambda d: d != F.col("_domain"),
            ),
            "_lookalike": lookalike_brand(F.substring_index("_domain", ".", 1)),
        }
    )
    domain = F.col("_domain")
    has_signature = F.coalesce("signed_by", F.lit("")) != ""
    has_security = F.coalesce("security", F.lit("")) != ""
    secure = F.contains("_security", F.lit("tls")) | F.contains("_security", F.lit("encrypt"))
    points = R.POINTS
    before = [
        Rule(
            _unrelated(domain, F.col("_mailed")),
            F.concat(F.lit("Domain mismatch: from @"), domain, F.lit(" but mailed-by "), "_mailed"),
            points["mailed_by"],
        ),
        Rule(
            has_signature & _unrelated(domain, F.col("_signed")),
            F.concat(F.lit("DKIM mismatch: from @"), domain, F.lit(" but signed-by "), "_signed"),
            points["signed_by"],
        ),
        Rule(~has_signature, "No DKIM signature (signed-by missing)", points["unsigned"]),
        Rule(
            has_security & ~secure,
            F.concat(F.lit("Weak or no encryption: "), "security"),
            points["weak_security"],
        ),
        Rule(~has_security, "No encryption information available", points["no_security"]),
        Rule(
            F.col("_brand").isNotNull() & F.col("_free"),
            F.concat(
                F.lit("Display name contains '"), "_brand",
                F.lit("' but sent from free provider @"), domain,
            ),
            points["brand_on_free"],
        ),
    ]
    after = [
        Rule(
            F.col("_free"),
            F.concat(F.lit("Sent from free email provider (@"), domain, F.lit(")")),
            points["free"],
        ),
        Rule(
            F.col("_lookalike").isNotNull(),
            F.concat(
                F.lit("Possible lookalike domain: @"), domain, F.lit(" resembles '"), "_lookalike",
                F.lit("'"),
            ),
            points["lookalike"],
        ),
    ]
    in_name = F.transform(
        "_others",
        lambda d: F.concat(
            F.lit("Display name contains email @"), d, F.lit(" but actual sender is @"), domain
        ),
    )
    scored = found.withColumns(
        {
            "_flags": F.concat(flags_of(before), in_name, flags_of(after)),
            "_points": points_of(before + after) + F.size("_others") * points["address_in_name"],
        }
    )
    unnamed = F.coalesce("from_email", F.lit("")) == ""
    no_domain = domain == ""
    missing = F.lit(points["no_domain"])
    total = F.when(unnamed, 0).when(no_domain, missing).otherwise(F.col("_points"))
    result = F.struct(
        (total >= R.SUSPICIOUS_AT).alias("is_suspicious"),
        score_of(total).alias("risk_score"),
        F.when(unnamed, F.array().cast("array<string>"))
        .when(no_domain, F.array(F.lit("Could not extract sender domain")))
        .otherwise(F.col("_flags"))
        .alias("flags"),
        F.col("_lookalike").alias("lookalike"),
    )
    given = F.coalesce(*[F.col(c) for c in FIELDS]).isNotNull()
    return scored.withColumn("sender_check", F.when(given, result)).drop(
        "_domain", "_name", "_mailed", "_signed", "_security", "_free", "_brand", "_others",
        "_lookalike", "_flags", "_points",
    )
