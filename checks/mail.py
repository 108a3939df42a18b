"""Queries and check SQL: headers, sender, authorship, explanation."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.curation import emails
from checks.duck import (
    NW,
    S,
    W,
    compact,
    ctes,
    edged,
    first_in,
    flags,
    full_text,
    hits,
    joined,
    lst,
    points,
    q,
    round_even,
    rx,
    score,
    sentences,
    strip,
    words,
)
from checks.urls import bar, big
from mailsieve.functions import text as T
from mailsieve.operators import authorship as A
from mailsieve.operators import explain as X
from mailsieve.operators import headers as H
from mailsieve.operators import senders as SE
from mailsieve.rules import authorship as AR
from mailsieve.rules import explain as XR
from mailsieve.rules import headers as HR
from mailsieve.rules import senders as SR
from mailsieve.sources.derived import AS_OF, AS_OF_EPOCH, load_table

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


# Headers
def _value(name: str) -> str:
    return f"coalesce(regexp_extract(raw_headers, '(?im)^{name}:[ \\t]*([^\\n]*)$', 1), '')"


def _dom(x: str) -> str:
    inner = f"CASE WHEN regexp_extract({x}, '<([^>]+)>', 1) <> '' THEN regexp_extract({x}, '<([^>]+)>', 1) ELSE {x} END"
    return f"CASE WHEN contains({inner}, '@') THEN lower({strip(f'list_last(string_split({inner}, {q(chr(64))}))')}) ELSE '' END"


def _auth(check: str) -> str:
    return f"coalesce(nullif(regexp_extract(lower(auth), '(?:^|{NW}){check}=({W}+)', 1), ''), 'none')"


_SPOOF = "CASE WHEN from_domain = '' THEN '' ELSE coalesce(" + ", ".join(
    f"CASE WHEN contains(nm, {q(b)}) AND NOT ({' OR '.join(f'ends_with(from_domain, {q(d)})' for d in ds)}) THEN {q(b)} END"
    for b, ds in HR.BRAND_DOMAINS.items()
) + ", '') END"
HEADERS = f"""h0 AS (SELECT email_id, raw_headers, {_value("Authentication-Results")} AS auth, {_value("Received-SPF")} AS rspf, {_value("DKIM-Signature")} AS sig,
    {_value("From")} AS frm, {_value("Reply-To")} AS rt, {_value("Return-Path")} AS rp, {_value("X-Mailer")} AS xm, {_value("User-Agent")} AS ua, {_value("Date")} AS dt
    FROM emails WHERE raw_headers IS NOT NULL AND raw_headers <> ''),
  h1 AS (SELECT *, CASE WHEN auth <> '' THEN {_auth("spf")} ELSE coalesce(nullif(regexp_extract(lower({strip("rspf")}), '^({W}+)', 1), ''), 'none') END AS spf_result,
    CASE WHEN auth <> '' THEN {_auth("dkim")} WHEN sig <> '' THEN 'present' ELSE 'none' END AS dkim_result,
    CASE WHEN auth <> '' THEN {_auth("dmarc")} ELSE 'none' END AS dmarc_result,
    {_dom("frm")} AS from_domain, {_dom("rt")} AS reply_to_domain, {_dom("rp")} AS return_path_domain,
    len(list_filter(string_split(raw_headers, chr(10)), lambda x: starts_with(lower(x), 'received:'))) AS received_hops,
    CASE WHEN xm <> '' THEN xm ELSE ua END AS mailer,
    lower(CASE WHEN regexp_extract({strip("frm")}, '^"?([^<"]+)"?{S}*<', 1) <> '' THEN regexp_extract({strip("frm")}, '^"?([^<"]+)"?{S}*<', 1) ELSE frm END) AS nm,
    coalesce(CAST(trunc((epoch(try_strptime(regexp_replace(dt, '^[A-Za-z]+,\\s*', ''), '%d %b %Y %H:%M:%S %z')) - {AS_OF_EPOCH}) / 86400.0) AS INTEGER), 0) AS date_days_diff FROM h0),
  h2 AS (SELECT *, reply_to_domain <> '' AND from_domain <> '' AND reply_to_domain <> from_domain AS reply_to_mismatch,
    return_path_domain <> '' AND from_domain <> '' AND return_path_domain <> from_domain AS return_path_mismatch, {_SPOOF} AS spoofed_brand,
    regexp_matches(lower(mailer), '{"|".join(HR.SUSPICIOUS_MAILERS)}') AS suspicious_mailer, date_days_diff > 7 OR date_days_diff < -90 AS date_anomaly FROM h1)"""
_P = HR.POINTS
_HEADER_RULES = [
    ("spf_result IN ('fail', 'softfail')", "'SPF ' || spf_result || ' — sender not authorised by domain'",
     f"CASE spf_result WHEN 'fail' THEN {_P['spf_fail']} ELSE {_P['spf_softfail']} END"),
    ("dkim_result = 'fail'", "'DKIM signature failed — message may be tampered'", _P["dkim_fail"]),
    ("dmarc_result = 'fail'", "'DMARC failed — domain alignment check failed'", _P["dmarc_fail"]),
    ("spf_result = 'none' AND dkim_result = 'none'", "'No SPF or DKIM authentication found'", _P["no_auth"]),
    ("reply_to_mismatch", "'Reply-To domain (' || reply_to_domain || ') differs from From domain (' || from_domain || ')'", _P["reply_to"]),
    ("return_path_mismatch", "'Return-Path domain (' || return_path_domain || ') differs from From domain (' || from_domain || ')'", _P["return_path"]),
    ("received_hops > 7", "'Unusually long Received chain (' || received_hops || ' hops) — possible mail relay abuse'", _P["many_hops"]),
    ("received_hops = 0", "'No Received headers — possibly hand-crafted or spoofed'", _P["no_hops"]),
    ("spoofed_brand <> ''", "'Display-name spoof: sender claims to be ' || upper(left(spoofed_brand, 1)) || substr(spoofed_brand, 2) || ' but email comes from ' || from_domain", _P["spoof"]),
    ("suspicious_mailer", "'Suspicious mailer detected: ' || left(mailer, 80)", _P["mailer"]),
    ("date_anomaly", "CASE WHEN date_days_diff > 0 THEN 'Email date is ' || date_days_diff || ' days in the future — likely spoofed' ELSE 'Email date is ' || abs(date_days_diff) || ' days in the past — suspicious' END", _P["date"]),
    (f"list_contains({lst(HR.FREE_DOMAINS)}, from_domain)", "'From address uses free/throwaway domain (' || from_domain || ')'", _P["free_domain"]),
]
_HP = points([(c, p) for c, _, p in _HEADER_RULES])
SCORED_HEADERS = f"""{HEADERS}, headers AS (SELECT *, {compact(flags([(c, f) for c, f, _ in _HEADER_RULES]))} AS flags, {score(_HP)} AS risk_score,
    ({_HP}) >= 25 AS is_suspicious FROM h2)"""


def scored_headers(spark, sf):
    return H.score_headers(emails(spark, sf), AS_OF).filter(F.col("headers").isNotNull())


@query(
    "header_fields",
    f"""{MAILS}, l AS (SELECT email_id, unnest(range(len(string_split(raw_headers, chr(10))))) AS pos, unnest(string_split(raw_headers, chr(10))) AS line FROM emails WHERE raw_headers IS NOT NULL)
    SELECT email_id, pos, lower(split_part(line, ':', 1)) AS name, regexp_replace(regexp_extract(line, '^[^:]*:(.*)$', 1), '^[ \\t]+', '') AS value FROM l WHERE contains(line, ':')""",
)
def _fields(spark, sf):
    return H.parse_headers(emails(spark, sf)).withColumn("pos", F.col("pos").cast("bigint"))


@query("header_auth", f"{MAILS}, {SCORED_HEADERS} SELECT email_id, spf_result, dkim_result, dmarc_result FROM headers")
def _auths(spark, sf):
    return scored_headers(spark, sf).select(
        "email_id", "headers.spf_result", "headers.dkim_result", "headers.dmarc_result"
    )


@query(
    "header_mismatch",
    f"""{MAILS}, {SCORED_HEADERS} SELECT email_id, from_domain, reply_to_domain, return_path_domain, reply_to_mismatch, return_path_mismatch,
    received_hops FROM headers""",
)
def _mismatch(spark, sf):
    out = scored_headers(spark, sf).select("email_id", "headers.*")
    return out.select(
        "email_id", "from_domain", "reply_to_domain", "return_path_domain", "reply_to_mismatch",
        "return_path_mismatch", big("received_hops"),
    )


@query(
    "header_spoof",
    f"""{MAILS}, {SCORED_HEADERS} SELECT email_id, spoofed_brand <> '' AS display_name_spoof, spoofed_brand, suspicious_mailer, mailer, date_anomaly, date_days_diff FROM headers""",
)
def _spoof(spark, sf):
    out = scored_headers(spark, sf).select("email_id", "headers.*")
    return out.select(
        "email_id", "display_name_spoof", "spoofed_brand", "suspicious_mailer", "mailer",
        "date_anomaly", "date_days_diff",
    )


@query("header_score", f"{MAILS}, {SCORED_HEADERS} SELECT email_id, risk_score, is_suspicious, {joined('flags')} AS flags FROM headers")
def _header_score(spark, sf):
    out = scored_headers(spark, sf).select("email_id", "headers.*")
    return out.select("email_id", "risk_score", "is_suspicious", bar("flags").alias("flags"))


# Sender
_SUBST = "b"
for _fake, _real in SR.LOOKALIKE_STEPS:
    _SUBST = f"replace({_SUBST}, {q(_fake)}, {q(_real)})"


def _unrelated(o: str) -> str:
    return f"{o} <> '' AND {o} <> d AND NOT ends_with({o}, '.' || d) AND NOT ends_with(d, '.' || {o})"


_LOOK = f"""list_filter({lst(sorted(SR.BRANDS))}, lambda x: x <> b AND ((length(x) = length(b) AND
  len(list_filter(range(1, length(x) + 1), lambda i: substr(x, i, 1) <> substr(b, i, 1))) BETWEEN 1 AND 2) OR (sub = x AND sub <> b)))[1]"""
SENDERS0 = f"""s0 AS (SELECT *, {strip("list_last(string_split(lower(" + strip("coalesce(from_email, '')") + "), '@'))")} AS d,
    {strip("coalesce(from_name, '')")} AS n, lower({strip("coalesce(mailed_by, '')")}) AS m, lower({strip("coalesce(signed_by, '')")}) AS sg,
    lower({strip("coalesce(security, '')")}) AS sc FROM emails WHERE coalesce(from_name, from_email, mailed_by, signed_by, security) IS NOT NULL),
  s1 AS (SELECT *, list_contains({lst(SR.FREE_PROVIDERS)}, d) AS free, {first_in("replace(lower(n), ' ', '')", sorted(SR.BRANDS))} AS br,
    list_filter(list_transform(regexp_extract_all(n, '{SE.NAME_ADDRESS}'), lambda a: lower(list_last(string_split(a, '@')))), lambda z: z <> d) AS oth,
    split_part(d, '.', 1) AS b FROM s0),
  s2 AS (SELECT *, {_SUBST} AS sub FROM s1), s3 AS (SELECT *, {_LOOK} AS look FROM s2)"""
_SP = SR.POINTS
_BEFORE = [
    (_unrelated("m"), "'Domain mismatch: from @' || d || ' but mailed-by ' || m", _SP["mailed_by"]),
    (f"coalesce(signed_by, '') <> '' AND {_unrelated('sg')}", "'DKIM mismatch: from @' || d || ' but signed-by ' || sg", _SP["signed_by"]),
    ("coalesce(signed_by, '') = ''", "'No DKIM signature (signed-by missing)'", _SP["unsigned"]),
    ("coalesce(security, '') <> '' AND NOT (contains(sc, 'tls') OR contains(sc, 'encrypt'))", "'Weak or no encryption: ' || security", _SP["weak_security"]),
    ("coalesce(security, '') = ''", "'No encryption information available'", _SP["no_security"]),
    ("br IS NOT NULL AND free", "'Display name contains ''' || br || ''' but sent from free provider @' || d", _SP["brand_on_free"]),
]
_AFTER = [
    ("free", "'Sent from free email provider (@' || d || ')'", _SP["free"]),
    ("look IS NOT NULL", "'Possible lookalike domain: @' || d || ' resembles ''' || look || ''''", _SP["lookalike"]),
]
_SPTS = f"({points([(c, p) for c, _, p in _BEFORE + _AFTER])} + 30 * len(oth))"
SCORED_SENDERS = f"""{SENDERS0}, s4 AS (SELECT *, CASE WHEN coalesce(from_email, '') = '' THEN 0 WHEN d = '' THEN 30 ELSE {_SPTS} END AS pts,
    CASE WHEN coalesce(from_email, '') = '' THEN []::VARCHAR[] WHEN d = '' THEN ['Could not extract sender domain'] ELSE
    list_concat(list_concat({compact(flags([(c, f) for c, f, _ in _BEFORE]))}, list_transform(oth, lambda z: 'Display name contains email @' || z || ' but actual sender is @' || d)),
      {compact(flags([(c, f) for c, f, _ in _AFTER]))}) END AS flags FROM s3),
  senders AS (SELECT email_id, look AS lookalike, flags, {score("pts")} AS risk_score, pts >= 25 AS is_suspicious FROM s4)"""


def scored_senders(spark, sf):
    out = SE.score_senders(emails(spark, sf)).filter(F.col("sender_check").isNotNull())
    return out.select("email_id", "sender_check.*")


@query("sender_score", f"{MAILS}, {SCORED_SENDERS} SELECT email_id, risk_score, is_suspicious, {joined('flags')} AS flags FROM senders")
def _sender_score(spark, sf):
    return scored_senders(spark, sf).select(
        "email_id", "risk_score", "is_suspicious", bar("flags").alias("flags")
    )


# Look-alike labels made from suppliers and parts: brands with letters replaced by position.
_LABEL = """CASE p_partkey % 6 WHEN 0 THEN replace(b, 'a', '4') WHEN 1 THEN replace(b, 'l', '1') WHEN 2 THEN replace(b, 'm', 'rn')
  WHEN 3 THEN b WHEN 4 THEN reverse(b) ELSE replace(b, 'o', '0') END"""
_BRANDLIST = lst(SR.BRANDS)


@query(
    "sender_lookalike",
    f"""WITH e AS (SELECT p_partkey AS part_id, {_LABEL} AS b FROM (SELECT p_partkey, {_BRANDLIST}[p_partkey % {len(SR.BRANDS)} + 1] AS b FROM part)),
    s AS (SELECT *, {_SUBST} AS sub FROM e) SELECT part_id, b AS label, {_LOOK} AS lookalike FROM s""",
)
def _lookalike(spark, sf):
    key = F.col("p_partkey")
    brand = F.get(F.array(*[F.lit(x) for x in SR.BRANDS]), (key % len(SR.BRANDS)).cast("int"))
    kind = key % 6

    def swap(a: str, b: str) -> F.Column:
        return F.replace(brand, F.lit(a), F.lit(b))

    label = (
        F.when(kind == 0, swap("a", "4")).when(kind == 1, swap("l", "1")).when(kind == 2, swap("m", "rn"))
        .when(kind == 3, brand).when(kind == 4, F.reverse(brand)).otherwise(swap("o", "0"))
    )
    rows = load_table(spark, sf, "part").select(key.alias("part_id"), label.alias("label"))
    return rows.withColumn("lookalike", SE.lookalike_brand(F.col("label")))


# Authorship
DOC_MAILS = "docs AS (SELECT doc_id AS email_id, NULL::VARCHAR AS subject, text FROM documents)"


def documents(spark, sf):
    docs = load_table(spark, sf, "documents")
    return docs.select(F.col("doc_id").alias("email_id"), F.lit(None).cast("string").alias("subject"), "text")


def _clamp(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


def authored(source: str) -> str:
    return f"""a0 AS (SELECT email_id, {full_text()} AS ft FROM {source}),
  a1 AS (SELECT *, {words("ft")} AS w, list_transform({sentences("ft")}, lambda s: len({words("s")})) AS sl, lower(ft) AS lt FROM a0),
  wc AS (SELECT email_id, w, count(*) AS c FROM (SELECT email_id, unnest(w) AS w FROM a1) GROUP BY email_id, w),
  en AS (SELECT email_id, sum(c) AS n, count(*) AS u, log2(sum(c)::DOUBLE) - sum(c * log2(c::DOUBLE)) / sum(c)::DOUBLE AS h FROM wc GROUP BY email_id),
  bw AS (SELECT email_id, w, lead(w) OVER (PARTITION BY email_id ORDER BY pos) AS w2 FROM (SELECT email_id, unnest(w) AS w, unnest(range(len(w))) AS pos FROM a1)),
  bi AS (SELECT email_id, count(DISTINCT w || ' ' || w2) AS ub FROM bw WHERE w2 IS NOT NULL GROUP BY email_id),
  st AS (SELECT email_id, avg(x) AS mu, sqrt(greatest(avg(x * x) - avg(x) * avg(x), 0)) AS sd, count(*) AS k FROM (SELECT email_id, unnest(sl)::DOUBLE AS x FROM a1) GROUP BY email_id),
  a2 AS (SELECT a1.email_id, ft, len(w) AS n, coalesce(u, 0) AS u, coalesce(h, 0) AS h, coalesce(ub, 0) AS ub, mu, sd, coalesce(k, 0) AS k, len({hits("lt", AR.CONNECTORS + AR.URGENCY)}) AS hit
    FROM a1 LEFT JOIN en USING (email_id) LEFT JOIN bi USING (email_id) LEFT JOIN st USING (email_id)),
  a3x AS (SELECT *, CASE WHEN k < 3 OR sd + mu = 0 THEN 0.5::DOUBLE ELSE {_clamp("0.3::DOUBLE - (sd - mu) / (sd + mu)")} END AS b,
    CASE WHEN n < 10 THEN 0.5::DOUBLE ELSE {_clamp("(9.0::DOUBLE - h) / 5.0::DOUBLE")} END AS p,
    CASE WHEN n < 5 THEN 0.5::DOUBLE ELSE {_clamp("(7.0::DOUBLE - u / sqrt(n)) / 5.0::DOUBLE")} END AS v,
    CASE WHEN n < 4 THEN 0.0::DOUBLE ELSE {_clamp("(1.0::DOUBLE - ub / (n - 1)) / 0.4::DOUBLE")} END AS r,
    CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE {_clamp("hit / n * 100.0::DOUBLE / 8.0::DOUBLE")} END AS f FROM a2),
  a3 AS (SELECT * REPLACE ({", ".join(f"{round_even(c)} AS {c}" for c in "bpvrf")}) FROM a3x),
  a4 AS (SELECT * REPLACE ({round_even("s")} AS s) FROM (SELECT *, least(1.0::DOUBLE, b * 0.30::DOUBLE + p * 0.25::DOUBLE + v * 0.15::DOUBLE + r * 0.15::DOUBLE + f * 0.15::DOUBLE) AS s FROM a3)),
  authorship AS (SELECT email_id, n >= 10 AND s >= 0.55::DOUBLE AS is_ai_generated, CASE WHEN n < 10 THEN 0.0::DOUBLE ELSE s END AS ai_authorship_score,
    CASE WHEN n < 10 THEN 0.0::DOUBLE ELSE b END AS burstiness_score, CASE WHEN n < 10 THEN 0.0::DOUBLE ELSE p END AS perplexity_proxy,
    CASE WHEN n < 10 THEN 0.0::DOUBLE ELSE v END AS vocabulary_richness, CASE WHEN n < 10 THEN 0.0::DOUBLE ELSE r END AS repetition_score,
    CASE WHEN n < 10 THEN 0.0::DOUBLE ELSE f END AS formality_score FROM a4)"""


DOCS = f"WITH {DOC_MAILS}, {authored('docs')}"


@query("words", f"WITH w AS (SELECT unnest({words('text')}) AS word FROM documents) SELECT word, count(*) AS n FROM w GROUP BY word")
def _words(spark, sf):
    tokens = load_table(spark, sf, "documents").select(F.explode_outer(T.words(F.col("text"))).alias("word"))
    return tokens.filter(F.col("word").isNotNull()).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("sentences", f"SELECT doc_id, {joined(sentences('text'))} AS sentences FROM documents")
def _sentences(spark, sf):
    return load_table(spark, sf, "documents").select("doc_id", bar(T.sentences(F.col("text"))).alias("sentences"))


def _signal(name: str, column, sql: str) -> None:
    def run(spark, sf):
        base = A.with_word_columns(documents(spark, sf)).withColumn("_hits", A.formality_hits())
        return base.select("email_id", column().alias("score"))

    query(name, f"{DOCS} SELECT email_id, {sql} AS score FROM a3")(run)


_signal("burstiness", lambda: A.burstiness_score(F.col("_lengths"), F.col("_mean")), "b")
_signal("root_ttr", A.vocabulary_score, "v")
_signal("bigram_repetition", A.repetition_score, "r")
_signal("formality", A.formality_score, "f")
_signal("perplexity", A.perplexity_score, "p")


@query("entropy", f"{DOCS} SELECT email_id, n::BIGINT AS words, round(h, 9) AS entropy FROM en")
def _entropy(spark, sf):
    out = A.entropy_by_group(documents(spark, sf))
    return out.withColumn("entropy", F.round("entropy", 9))


@query("authorship", f"{DOCS} SELECT * FROM authorship")
def _authorship(spark, sf):
    out = A.authorship(documents(spark, sf)).select("email_id", "authorship.*")
    return out.drop("signals")


@query(
    "authorship_emails",
    f"{MAILS}, {authored('emails')} SELECT email_id, is_ai_generated, ai_authorship_score FROM authorship",
)
def _authorship_mails(spark, sf):
    out = A.authorship(emails(spark, sf)).select("email_id", "authorship.*")
    return out.select("email_id", "is_ai_generated", "ai_authorship_score")


_LOUD = [
    ("b", 0.6, "Low sentence-length burstiness (%.2f) — uniform structure typical of LLMs"),
    ("p", 0.6, "Low lexical entropy (%.2f) — predictable word choices typical of AI"),
    ("v", 0.6, "Low vocabulary richness (%.2f) — limited lexical diversity"),
    ("r", 0.5, "High bigram repetition (%.2f) — repeated phrase patterns"),
    ("f", 0.5, "High formal/AI discourse marker density (%.2f)"),
]
_SHOWN = compact("[" + ", ".join(f"CASE WHEN {c} >= {line}::DOUBLE THEN printf({q(text)}, {c}) END" for c, line, text in _LOUD) + "]")
_QUIET = """CASE WHEN s >= 0.55::DOUBLE THEN 'Multiple weak AI-authorship signals detected' ELSE 'No strong AI-authorship signals detected' END"""


@query(
    "authorship_signals",
    f"""{MAILS}, {authored('emails')} SELECT email_id, CASE WHEN n < 10 THEN 'Text too short for reliable AI authorship analysis'
    WHEN len({_SHOWN}) > 0 THEN array_to_string({_SHOWN}, '|') ELSE {_QUIET} END AS signals FROM a4""",
)
def _signals(spark, sf):
    out = A.authorship(emails(spark, sf))
    return out.select("email_id", bar("authorship.signals").alias("signals"))


# Explanation
def _family(text: str, family: str) -> str:
    return " OR ".join(f"regexp_matches({text}, '{edged(p)}')" for p in XR.FAMILIES[family])


CATEGORIES = "[" + ", ".join(f"CASE WHEN {_family('lt', f)} THEN {q(f)} END" for f in XR.FAMILIES) + "]"
CATS = f"""c0 AS (SELECT email_id, {full_text()} AS ft, lower({full_text()}) AS lt FROM emails),
  cats AS (SELECT *, {compact(CATEGORIES)} AS risk_categories FROM c0)"""


@query("risk_categories", f"{MAILS}, {CATS} SELECT email_id, {joined('risk_categories')} AS risk_categories FROM cats")
def _categories(spark, sf):
    mails = emails(spark, sf)
    out = X.with_risk_categories(mails, T.full_text(F.col("subject"), F.col("text")))
    return out.select("email_id", bar("risk_categories").alias("risk_categories"))


@query(
    "risk_categories_conversations",
    f"""WITH emails AS (SELECT conv_id * 1000 + turn AS email_id, NULL::VARCHAR AS subject, role || ': please ' || text || CASE turn % 3 WHEN 0 THEN ' click the link' WHEN 1 THEN ' security code' ELSE '' END AS text FROM conversations), {CATS}
    SELECT email_id, {joined("risk_categories")} AS risk_categories FROM cats""",
)
def _turn_categories(spark, sf):
    turn = F.col("turn") % 3
    ending = F.when(turn == 0, " click the link").when(turn == 1, " security code").otherwise("")
    rows = load_table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("email_id"),
        F.concat("role", F.lit(": please "), "text", ending).alias("text"),
    )
    out = X.with_risk_categories(rows, F.col("text"))
    return out.select("email_id", bar("risk_categories").alias("risk_categories"))


_PATTERNS = [p for f in XR.WORD_FAMILIES for p in XR.FAMILIES[f]]


def _first(p: str) -> str:
    body = rx(p.removeprefix(r"\b").removesuffix(r"\b"))
    return f"nullif(regexp_extract(lt, '(?:^|{NW})({body})(?:$|{NW})', 1), '')"


_SINGLE = "|".join(rx(p.removeprefix(r"\b").removesuffix(r"\b")) for p in _PATTERNS if " " not in p)
TOKENS = f"""t0 AS (SELECT email_id, {full_text()} AS ft, lower({full_text()}) AS lt FROM emails),
  t1 AS (SELECT *, {compact("[" + ", ".join(_first(p) for p in _PATTERNS) + "]")} AS ms,
    list_filter(regexp_split_to_array(ft, '{S}+'), lambda x: x <> '') AS raw FROM t0),
  t2 AS (SELECT email_id, ms, pos, token, lower(regexp_replace(token, '{NW}', '', 'g')) AS clean FROM (SELECT email_id, ms, unnest(range(len(raw))) AS pos, unnest(raw) AS token FROM t1)),
  rules AS (SELECT email_id, pos, token, clean, CASE WHEN regexp_full_match(clean, '{_SINGLE}') THEN 0.85::DOUBLE
    WHEN len(list_filter(ms, lambda m: contains(m, clean))) > 0 THEN 0.75::DOUBLE ELSE 0.05::DOUBLE END AS raw_score FROM t2)"""


def scored_tokens(source: str) -> str:
    return f"""tokens AS (SELECT * REPLACE ({round_even('score')} AS score) FROM (SELECT *, raw_score / CASE WHEN max(raw_score) OVER (PARTITION BY email_id) = 0 THEN 1.0::DOUBLE
    ELSE max(raw_score) OVER (PARTITION BY email_id) END AS score FROM {source})),
  top0 AS (SELECT *, row_number() OVER (PARTITION BY email_id, clean ORDER BY score DESC, pos) AS first FROM tokens WHERE score >= 0.55::DOUBLE AND length(clean) > 2),
  top1 AS (SELECT *, row_number() OVER (PARTITION BY email_id ORDER BY score DESC, pos) AS rank FROM top0 WHERE first = 1),
  top_tokens AS (SELECT e.email_id, coalesce(array_to_string(list(t.token ORDER BY t.rank) FILTER (WHERE t.rank IS NOT NULL), '|'), '') AS top_tokens
    FROM emails e LEFT JOIN top1 t ON e.email_id = t.email_id AND t.rank <= 10 GROUP BY e.email_id)"""


@query(
    "attribute_tokens",
    f"""{MAILS}, {TOKENS}, {scored_tokens("rules")} SELECT email_id, pos AS pos, token, score, score >= 0.55::DOUBLE AS is_highlighted FROM tokens""",
)
def _attribute(spark, sf):
    rows = X.attribute_tokens(emails(spark, sf)).select("email_id", F.inline_outer("tokens"))
    return rows.filter(F.col("pos").isNotNull()).select(
        "email_id", F.col("pos").cast("bigint").alias("pos"), "token", "score", "is_highlighted"
    )


@query("top_tokens", f"{MAILS}, {TOKENS}, {scored_tokens('rules')} SELECT email_id, top_tokens FROM top_tokens")
def _top(spark, sf):
    out = X.top_tokens(X.attribute_tokens(emails(spark, sf)))
    return out.select("email_id", bar("top_tokens").alias("top_tokens"))


# Word pieces made of each email's words: four letters, the rest marked as continuation.
PIECES = f"""w0 AS (SELECT email_id, unnest({words("text")}) AS word, unnest(range(len({words("text")}))) AS no FROM emails),
  pieces AS (SELECT email_id, no * 2 AS pos, left(word, 4) AS token, (no * 7 % 100) / 100.0::DOUBLE AS score FROM w0
    UNION ALL SELECT email_id, no * 2 + 1, '##' || substr(word, 5), (no * 13 % 100) / 100.0::DOUBLE FROM w0 WHERE length(word) > 4)"""
MERGED = """merged AS (SELECT email_id, min(pos) AS pos, string_agg(CASE WHEN starts_with(token, '##') THEN substr(token, 3) ELSE token END, '' ORDER BY pos) AS token,
    max(score) AS score FROM (SELECT *, sum(CASE WHEN starts_with(token, '##') THEN 0 ELSE 1 END) OVER (PARTITION BY email_id ORDER BY pos) AS word_no FROM pieces) GROUP BY email_id, word_no)"""


def pieces(spark, sf):
    found = emails(spark, sf).select("email_id", F.posexplode_outer(T.words(F.col("text"))).alias("no", "word"))
    no, word = F.col("no").cast("bigint"), F.col("word")
    head = F.struct((no * 2).alias("pos"), F.substring(word, 1, 4).alias("token"), ((no * 7 % 100) / 100.0).alias("score"))
    tail = F.struct(
        (no * 2 + 1).alias("pos"), F.concat(F.lit("##"), F.substring(word, F.lit(5), F.char_length(word))).alias("token"),
        ((no * 13 % 100) / 100.0).alias("score"),
    )
    both = F.array_compact(F.array(head, F.when(F.char_length(word) > 4, tail)))
    return found.filter(F.col("word").isNotNull()).select("email_id", F.inline_outer(both))


@query("wordpiece_merge", f"{MAILS}, {PIECES}, {MERGED} SELECT email_id, pos, token, score FROM merged WHERE token <> ''")
def _pieces(spark, sf):
    return X.merge_wordpieces(pieces(spark, sf)).drop("word_no")


BLEND = f"""wk AS (SELECT email_id, ltrim(lower(token), '#') AS k, arg_max(score, pos) AS w FROM merged WHERE token <> '' GROUP BY email_id, k),
  has AS (SELECT DISTINCT email_id FROM wk),
  blended AS (SELECT r.email_id, pos, token, clean, CASE WHEN h.email_id IS NULL THEN raw_score ELSE {round_even('coalesce(w, raw_score * 0.5::DOUBLE) * 0.6::DOUBLE + raw_score * 0.4::DOUBLE')} END AS raw_score
    FROM rules r LEFT JOIN wk ON r.email_id = wk.email_id AND wk.k = ltrim(lower(r.token), '#') LEFT JOIN has h ON r.email_id = h.email_id)"""


@query(
    "blend_token_weights",
    f"{MAILS}, {TOKENS}, {PIECES}, {MERGED}, {BLEND}, {scored_tokens('blended')} SELECT email_id, top_tokens FROM top_tokens",
)
def _blend(spark, sf):
    weights = X.merge_wordpieces(pieces(spark, sf))
    out = X.top_tokens(X.attribute_tokens(emails(spark, sf), weights))
    return out.select("email_id", bar("top_tokens").alias("top_tokens"))
