"""Header layer: header block to fields, authentication, mismatches, score."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.functions.columns import (
    Rule,
    as_column,
    flags_of,
    in_set,
    points_of,
    score_of,
    sql_array,
    sql_text,
    title_case,
    with_value,
)
from mailsieve.functions.text import SPACE, WORD_CHAR, WORD_START, strip
from mailsieve.rules import headers as R

NO_HEADERS = "No headers provided"


def header_block(raw: Column) -> Column:
    """Header part with folded lines joined, up to the first empty line."""
    unix = F.regexp_replace(raw, r"\r\n?", "\n")
    unfolded = F.regexp_replace(unix, r"\n([ \t])", "$1")
    return F.substring_index(unfolded, "\n\n", 1)


def header_value(block: Column, name: str) -> Column:
    """First value of a header field, '' if it is missing."""
    return F.regexp_extract(block, rf"(?imd)^{re.escape(name)}:[ \t]*(.*)$", 1)


def parse_headers(df: DataFrame, col: str = "raw_headers") -> DataFrame:
    """One row per header field: email_id, pos, name (lower case), value."""
    lines = F.split(header_block(F.col(col)), "\n")
    rows = df.filter(F.col(col).isNotNull()).select("email_id", F.posexplode_outer(lines))
    return rows.filter(F.rlike("col", F.lit(r"^[!-9;-~]+:"))).select(
        "email_id",
        "pos",
        F.lower(F.substring_index("col", ":", 1)).alias("name"),
        F.regexp_replace(F.regexp_extract("col", r"(?s)^[^:]*:(.*)$", 1), r"^[ \t]+", "").alias(
            "value"
        ),
    )


def address_domain(address: Column) -> Column:
    """Domain of 'Name <user@host>' or 'user@host', '' if there is none."""
    inside = F.regexp_extract(address, r"<([^>]+)>", 1)
    plain = F.when(inside != "", inside).otherwise(address)
    domain = F.lower(strip(F.substring_index(plain, "@", -1)))
    return F.when(F.contains(plain, F.lit("@")), domain).otherwise("")


def auth_value(results: Column, check: str) -> Column:
    """Result of one check in an Authentication-Results value, 'none' if missing."""
    found = F.regexp_extract(F.lower(results), rf"{WORD_START}{check}=({WORD_CHAR}+)", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("none"))


def header_date(value: Column) -> Column:
    """Timestamp of a Date header; NULL if it cannot be read or has no known zone."""
    text = F.regexp_replace(strip(value), r"\s*\([^)]*\)$", "")
    text = F.regexp_replace(text, r"^[A-Za-z]{3,9},\s*", "")
    text = F.regexp_replace(text, r"\s+(?:GMT|UTC|UT|Z)$", " +0000")
    known = ~F.endswith(text, F.lit("-0000"))
    return F.when(
        known,
        F.coalesce(
            F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss Z")),
            F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm Z")),
        ),
    )


def spoofed_brand(from_header: Column, from_domain: Column) -> Column:
    """First brand (list order) named by the sender whose domains it does not use, or ''."""
    shown = F.regexp_extract(strip(from_header), rf'^"?([^<"]+)"?{SPACE}*<', 1)
    name = F.lower(F.when(shown != "", shown).otherwise(from_header))
    rows = [
        f"named_struct('brand', {sql_text(brand)}, 'domains', {sql_array(domains)})"
        for brand, domains in R.BRAND_DOMAINS.items()
    ]
    brands = F.expr(f"array({', '.join(rows)})")
    claimed = with_value(
        F.struct(name.alias("name"), from_domain.alias("domain")),
        lambda f: F.filter(
            brands,
            lambda b: F.contains(f["name"], b["brand"])
            & ~F.exists(b["domains"], lambda d: F.endswith(f["domain"], d)),
        ),
    )
    first = F.coalesce(F.get(claimed, F.lit(0))["brand"], F.lit(""))
    return F.when(from_domain != "", first).otherwise("")


def header_fields(df: DataFrame, as_of: str, col: str = "raw_headers") -> DataFrame:
    """Add the fields the header rules look at, each under its own name. Narrow."""
    block = df.withColumn("_block", header_block(F.col(col)))
    names = {
        "_auth": "Authentication-Results",
        "_received_spf": "Received-SPF",
        "_signature": "DKIM-Signature",
        "_from": "From",
        "_reply_to": "Reply-To",
        "_return_path": "Return-Path",
        "_x_mailer": "X-Mailer",
        "_agent": "User-Agent",
        "_date": "Date",
    }
    values = block.withColumns({k: header_value(F.col("_block"), v) for k, v in names.items()})
    auth = F.col("_auth")
    first_word = F.regexp_extract(F.lower(strip(F.col("_received_spf"))), rf"^({WORD_CHAR}+)", 1)
    spf = F.coalesce(F.nullif(first_word, F.lit("")), F.lit("none"))
    dkim = F.when(F.col("_signature") != "", "present").otherwise("none")
    x_mailer = F.col("_x_mailer")
    fields = values.withColumns(
        {
            "spf_result": F.when(auth != "", auth_value(auth, "spf")).otherwise(spf),
            "dkim_result": F.when(auth != "", auth_value(auth, "dkim")).otherwise(dkim),
            "dmarc_result": F.when(auth != "", auth_value(auth, "dmarc")).otherwise("none"),
            "from_domain": address_domain(F.col("_from")),
            "reply_to_domain": address_domain(F.col("_reply_to")),
            "return_path_domain": address_domain(F.col("_return_path")),
            "received_hops": F.regexp_count("_block", F.lit(r"(?imd)^received:")),
            "mailer": F.when(x_mailer != "", x_mailer).otherwise(F.col("_agent")),
            "_sent": header_date(F.col("_date")),
        }
    )
    now = F.unix_micros(F.lit(as_of).cast("timestamp"))
    days = ((F.unix_micros("_sent") - now) / F.lit(86_400_000_000.0)).cast("int")

    def differs(domain: str) -> Column:
        other = F.col(domain)
        return (other != "") & (F.col("from_domain") != "") & (other != F.col("from_domain"))

    mailers = "|".join(f"(?:{m})" for m in R.SUSPICIOUS_MAILERS)
    return fields.withColumns(
        {
            "reply_to_mismatch": differs("reply_to_domain"),
            "return_path_mismatch": differs("return_path_domain"),
            "spoofed_brand": spoofed_brand(F.col("_from"), F.col("from_domain")),
            "suspicious_mailer": F.rlike(F.lower("mailer"), F.lit(mailers)),
            "date_days_diff": F.coalesce(days, F.lit(0)),
        }
    ).withColumns(
        {
            "display_name_spoof": F.col("spoofed_brand") != "",
            "date_anomaly": (F.col("date_days_diff") > R.MAX_DAYS_AHEAD)
            | (F.col("date_days_diff") < -R.MAX_DAYS_BACK),
        }
    ).drop("_block", *names, "_sent")


def header_rules(mailer_chars: int = 80) -> list[Rule]:
    spf, dkim, dmarc = F.col("spf_result"), F.col("dkim_result"), F.col("dmarc_result")
    sender = F.col("from_domain")
    hops, days = F.col("received_hops"), F.col("date_days_diff")
    points = R.POINTS
    spf_points = F.when(spf == "fail", points["spf_fail"]).otherwise(points["spf_softfail"])
    return [
        Rule(
            spf.isin("fail", "softfail"),
            F.concat(F.lit("SPF "), spf, F.lit(" — sender not authorised by domain")),
            spf_points,
        ),
        Rule(
            dkim == "fail",
            "DKIM signature failed — message may be tampered",
            points["dkim_fail"],
        ),
        Rule(
            dmarc == "fail",
            "DMARC failed — domain alignment check failed",
            points["dmarc_fail"],
        ),
        Rule(
            (spf == "none") & (dkim == "none"),
            "No SPF or DKIM authentication found",
            points["no_auth"],
        ),
        Rule(
            F.col("reply_to_mismatch"),
            F.concat(
                F.lit("Reply-To domain ("), "reply_to_domain", F.lit(") differs from From domain ("),
                "from_domain", F.lit(")"),
            ),
            points["reply_to"],
        ),
        Rule(
            F.col("return_path_mismatch"),
            F.concat(
                F.lit("Return-Path domain ("), "return_path_domain",
                F.lit(") differs from From domain ("), "from_domain", F.lit(")"),
            ),
            points["return_path"],
        ),
        Rule(
            hops > R.MAX_HOPS,
            F.format_string(
                "Unusually long Received chain (%d hops) — possible mail relay abuse", hops
            ),
            points["many_hops"],
        ),
        Rule(
            hops == 0,
            "No Received headers — possibly hand-crafted or spoofed",
            points["no_hops"],
        ),
        Rule(
            F.col("display_name_spoof"),
            F.concat(
                F.lit("Display-name spoof: sender claims to be "),
                title_case(F.col("spoofed_brand")), F.lit(" but email comes from "), sender,
            ),
            points["spoof"],
        ),
        Rule(
            F.col("suspicious_mailer"),
            F.concat(F.lit("Suspicious mailer detected: "), F.substring("mailer", 1, mailer_chars)),
            points["mailer"],
        ),
        Rule(
            F.col("date_anomaly"),
            F.when(
                days > 0, F.format_string("Email date is %d days in the future — likely spoofed", days)
            ).otherwise(F.format_string("Email date is %d days in the past — suspicious", -days)),
            points["date"],
        ),
        Rule(
            in_set(sender, R.FREE_DOMAINS),
            F.concat(F.lit("From address uses free/throwaway domain ("), sender, F.lit(")")),
            points["free_domain"],
        ),
    ]


RESULT_FIELDS = [
    "spf_result", "dkim_result", "dmarc_result", "reply_to_mismatch", "from_domain",
    "reply_to_domain", "return_path_domain", "return_path_mismatch", "received_hops",
    "display_name_spoof", "spoofed_brand", "suspicious_mailer", "mailer", "date_anomaly",
    "date_days_diff",
]
_BLANK = {
    "spf_result": "none", "dkim_result": "none", "dmarc_result": "none",
    "reply_to_mismatch": False, "from_domain": "", "reply_to_domain": "",
    "return_path_domain": "", "return_path_mismatch": False, "received_hops": 0,
    "display_name_spoof": False, "spoofed_brand": "", "suspicious_mailer": False, "mailer": "",
    "date_anomaly": False, "date_days_diff": 0,
}


def score_headers(df: DataFrame, as_of: str, col: str = "raw_headers") -> DataFrame:
    """Add a struct column ``headers``; NULL where there is no header field. Narrow."""
    fields = header_fields(df, as_of, col)
    rules = header_rules()
    scored = fields.withColumns({"_flags": flags_of(rules), "_points": points_of(rules)})
    blank = strip(F.col(col)) == ""

    def unless_blank(value: Column, empty) -> Column:
        return F.when(blank, as_column(empty) if isinstance(empty, str) else F.lit(empty)).otherwise(
            value
        )

    result = F.struct(
        *[unless_blank(F.col(n), _BLANK[n]).alias(n) for n in RESULT_FIELDS],
        unless_blank(F.col("_points") >= R.SUSPICIOUS_AT, False).alias("is_suspicious"),
        unless_blank(score_of(F.col("_points")), 0.0).alias("risk_score"),
        F.when(blank, F.array(F.lit(NO_HEADERS))).otherwise(F.col("_flags")).alias("flags"),
    )
    present = F.col(col).isNotNull() & (F.col(col) != "")
    return scored.withColumn("headers", F.when(present, result)).drop(
        "_flags", "_points", *RESULT_FIELDS
    )
