"""Building blocks of the check SQL: fixed values as literals, text and URL expressions."""

from __future__ import annotations

from mailsieve.functions import urls as U
from mailsieve.sources.derived import SQL

W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"
SP = r"\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
S = f"[{SP}]"
NS = f"[^{SP}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]" if values else "[]::VARCHAR[]"


def ctes(*names: str) -> str:
    """WITH clause holding derived tables."""
    parts = []
    for name in names:
        sql = SQL[name].format(documents="documents", pages="pages")
        parts.append(f"{name} AS ({sql})")
    return "WITH " + ",\n".join(parts)


def rx(pattern: str) -> str:
    """Rule pattern to RE2 text for boolean tests and group-free use."""
    return (
        pattern.replace(r"\w", W).replace(r"\S", NS).replace(r"\s", S).replace(r"\d", r"\p{Nd}")
        .replace(".*", "[^\\n]*")
    )


def edged(pattern: str) -> str:
    """Rule pattern with word edges spelled as neighbouring characters."""
    body = pattern
    head = tail = ""
    if body.startswith(r"\b"):
        head, body = f"(?:^|{NW})", body[2:]
    if body.endswith(r"\b"):
        tail, body = f"(?:$|{NW})", body[:-2]
    body = body.replace(r"\b.*\b", f"(?:{NW}[^\\n]*{NW}|{NW})")
    return f"{head}(?:{rx(body)}){tail}"


def strip(expr: str) -> str:
    return f"regexp_replace(regexp_replace({expr}, '^{S}+', ''), '{S}+$', '')"


def words(expr: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(lower({expr}), '{NW}+'), "
        "lambda x: regexp_full_match(x, '[a-z]{2,}'))"
    )


def sentences(expr: str) -> str:
    return (
        f"list_filter(list_transform(string_split(regexp_replace({strip(expr)}, '([.!?]){S}+', "
        f"'\\1' || chr(1), 'g'), chr(1)), lambda x: {strip('x')}), lambda x: length(x) > 5)"
    )


def full_text(subject: str = "subject", text: str = "text") -> str:
    joined = f"coalesce({subject}, '') || ' ' || {text}"
    return strip(joined)


_TAIL = r"[/\p{L}\p{N}_\-.~:?#\[\]@!$&''()*+,;=%]*"
_HREF = rf"""(?i)<a{S}+[^>]*href{S}*={S}*["'']([^"'']+)["'']"""
_SRC = rf"""(?i)<(?:img|iframe|source){S}+[^>]*src{S}*={S}*["'']([^"'']+)["'']"""
_PLAIN = rf"(?i)https?://(?:[-.]|{W}|%[\p{{Nd}}a-fA-F]{{2}}){_TAIL}"
_BARE = rf"(?i)(?:^|{NW})(www\.[a-zA-Z0-9][-a-zA-Z0-9]*\.[a-zA-Z]{{2,}}{_TAIL})"


def urls(expr: str) -> str:
    """Ordered distinct URLs of a text."""
    trail = U.TRAILING.replace("'", "''")
    all_found = (
        f"list_concat(list_concat(regexp_extract_all({expr}, '{_HREF}', 1), "
        f"list_filter(regexp_extract_all({expr}, '{_SRC}', 1), "
        "lambda u: starts_with(u, 'http://') OR starts_with(u, 'https://'))), "
        f"list_concat(regexp_extract_all({expr}, '{_PLAIN}'), "
        f"list_transform(regexp_extract_all({expr}, '{_BARE}', 1), lambda u: 'http://' || u)))"
    )
    stripped = strip(f"rtrim(u, '{trail}')")
    cleaned = (
        f"list_filter(list_transform({all_found}, lambda u: {stripped}), "
        "lambda u: starts_with(u, 'http://') OR starts_with(u, 'https://'))"
    )
    return f"coalesce({distinct_in_order(cleaned)}, []::VARCHAR[])"


def distinct_in_order(expr: str) -> str:
    return (
        f"list_transform(list_filter(list_transform({expr}, lambda x, i: {{'x': x, 'i': i, "
        f"'p': list_position({expr}, x)}}), lambda s: s.i = s.p), lambda s: s.x)"
    )


def except_list(a: str, b: str) -> str:
    return f"list_filter({a}, lambda x: NOT list_contains({b}, x))"


EMAIL = rf"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}\b"

# Emails with their URL list: text, subject, then HTML URLs not there yet.
PARSED = f"""parsed0 AS (SELECT *, {urls('text')} AS tu, CASE WHEN subject IS NULL THEN []::VARCHAR[] ELSE {urls('subject')} END AS su,
  CASE WHEN email_html IS NULL THEN []::VARCHAR[] ELSE {urls('email_html')} END AS hu FROM emails),
parsed AS (SELECT * EXCLUDE (tu, su, hu), list_concat(tu, su) AS body_urls,
  list_concat(list_concat(tu, su), {except_list('hu', 'list_concat(tu, su)')}) AS urls FROM parsed0)"""

EMAIL_URLS = """email_urls AS (SELECT email_id, crawl_urls, take_screenshots, pos, url,
  list_position(urls, url) = pos + 1 AS first_seen
  FROM (SELECT *, unnest(range(len(urls))) AS pos, unnest(urls) AS url FROM parsed))"""


def shape(url: str, group: int) -> str:
    return (
        f"regexp_extract({url}, '^(?:([a-zA-Z][a-zA-Z0-9+.\\-]*):)?(?://([^/?#]*))?([^?#]*)', {group})"
    )


def host(url: str) -> str:
    return shape(url, 2)


def domain(url: str) -> str:
    h = host(url)
    return (
        f"split_part(CASE WHEN {h} <> '' THEN {h} ELSE split_part({shape(url, 3)}, '/', 1) END, ':', 1)"
    )


def first_in(text: str, values) -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, {q(v)}) THEN {q(v)}" for v in values) + " END"


def hits(text: str, values) -> str:
    return f"list_filter({lst(values)}, lambda p: contains({text}, p))"


def flags(rules) -> str:
    """'|'-joined flags of (condition, flag SQL) pairs."""
    items = ", ".join(f"CASE WHEN {c} THEN {f} END" for c, f in rules)
    return f"[{items}]"


def compact(expr: str) -> str:
    return f"list_filter({expr}, lambda x: x IS NOT NULL)"


def joined(expr: str) -> str:
    return f"coalesce(array_to_string({expr}, '|'), '')"


def points(rules) -> str:
    return " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p in rules)


def score(expr: str) -> str:
    return f"CAST(least({expr}, 100) AS DOUBLE) / CAST(100.0 AS DOUBLE)"


def latest(table: str, key: str) -> str:
    """Newest row per key: by time, then by page_id."""
    return (
        f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} "
        f"ORDER BY observed_epoch DESC, page_id DESC) AS rn FROM {table}) WHERE rn = 1)"
    )


def round_even(x: str, digits: int = 4) -> str:
    """Nearest decimal, ties to the even digit, read off the exact digits of the double."""
    point = "strpos(t, '.')"
    kept = f"CAST(replace(left(t, {point} + {digits}), '.', '') AS BIGINT)"
    rest = f"substr(t, {point} + {digits + 1})"
    half = "5" + "0" * (69 - digits)
    up = f"CASE WHEN {rest} > '{half}' THEN 1 WHEN {rest} = '{half}' THEN {kept} % 2 ELSE 0 END"
    return (
        f"(CASE WHEN {x} < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * "
        f"list_transform([printf('%.70f', abs(CAST({x} AS DOUBLE)))], lambda t: "
        f"CAST({kept} + {up} AS DOUBLE))[1] / {10**digits}::DOUBLE)"
    )
