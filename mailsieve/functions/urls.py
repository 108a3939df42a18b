"""Finding URLs in text and taking them apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsieve.functions.text import EMAIL_ADDRESS, HTML_TAG, SPACE, WORD_CHAR, strip

# Characters a URL may go on with, and those cut from its end.
_TAIL = r"[/\p{L}\p{N}_\-.~:?#\[\]@!$&'()*+,;=%]*"
TRAILING = ".,;:!?)'\">"

HREF = rf"""(?i)<a{SPACE}+[^>]*href{SPACE}*={SPACE}*["']([^"']+)["']"""
SRC = rf"""(?i)<(?:img|iframe|source){SPACE}+[^>]*src{SPACE}*={SPACE}*["']([^"']+)["']"""
# The tail takes every character a host may hold, so one host character is enough.
PLAIN = rf"(?i)https?://(?:[-.]|{WORD_CHAR}|%[\p{{Nd}}a-fA-F]{{2}}){_TAIL}"
BARE = rf"(?i)w(?<!{WORD_CHAR}w)ww\.[a-zA-Z0-9][-a-zA-Z0-9]*\.[a-zA-Z]{{2,}}{_TAIL}"

# scheme, host part, path
URL_SHAPE = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"


def _is_http(url: Column) -> Column:
    return F.startswith(url, F.lit("http://")) | F.startswith(url, F.lit("https://"))


def _all_if(text: Column, mark: str, pattern: str, group: int) -> Column:
    """All matches of a pattern that cannot match without the mark."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    none = F.array().cast("array<string>")
    return F.when(F.contains(text, F.lit(mark)), found).otherwise(none)


def extract_urls(text: Column) -> Column:
    """Distinct URLs: links, embedded sources, plain URLs and bare www hosts, in that order."""
    links = _all_if(text, "<", HREF, 1)
    embedded = F.filter(_all_if(text, "<", SRC, 1), _is_http)
    plain = _all_if(text, "://", PLAIN, 0)
    bare = F.transform(
        F.regexp_extract_all(text, F.lit(BARE), F.lit(0)), lambda u: F.concat(F.lit("http://"), u)
    )
    found = F.transform(
        F.concat(links, embedded, plain, bare), lambda u: strip(F.rtrim(u, F.lit(TRAILING)))
    )
    none = F.array().cast("array<string>")
    return F.coalesce(F.array_distinct(F.filter(found, _is_http)), none)


def extract_sender(text: Column) -> Column:
    """First email address in the text, or NULL."""
    first = F.nullif(F.regexp_extract(text, EMAIL_ADDRESS, 0), F.lit(""))
    return F.when(F.contains(text, F.lit("@")), first)


def has_html(text: Column) -> Column:
    return F.rlike(text, F.lit(HTML_TAG))


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URL_SHAPE, 1))


def url_host(url: Column) -> Column:
    """Part between '//' and the path, with user info and port."""
    return F.regexp_extract(url, URL_SHAPE, 2)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, URL_SHAPE, 3)


def url_domain(url: Column) -> Column:
    """Host up to the first colon; the first path part when there is no host."""
    host = url_host(url)
    raw = F.when(host != "", host).otherwise(F.substring_index(url_path(url), "/", 1))
    return F.substring_index(raw, ":", 1)


def is_malformed(url: Column) -> Column:
    """True if the host has only one of the brackets '[' and ']'."""
    host = url_host(url)
    return F.contains(host, F.lit("[")) != F.contains(host, F.lit("]"))
