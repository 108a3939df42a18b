"""Cleaning and tokenising of text.

White space, word characters and word edges are spelled out as Unicode classes, so
that a pattern means the same on every regex engine and for every language.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsieve.functions.columns import with_value

SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_SPACE_SET = (
    r"\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# What most characters are comes first in a class, so they are settled by one comparison.
SPACE = f"[[^!-~]&&[{_SPACE_SET}]]"
NOT_SPACE = f"[!-~[^{_SPACE_SET}]]"
WORD_CHAR = r"[a-z[A-Z0-9_\p{L}\p{N}]]"
WORD_START = rf"(?<!{WORD_CHAR})"
WORD_END = rf"(?!{WORD_CHAR})"
EDGE = rf"(?:(?<={WORD_CHAR})(?!{WORD_CHAR})|(?<!{WORD_CHAR})(?={WORD_CHAR}))"

WORDS = rf"{WORD_START}[a-z]{{2,}}+{WORD_END}"

# Address, link and phone patterns that results are compared on.
EMAIL_ADDRESS = rf"{EDGE}[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}{EDGE}"
INFERENCE_URL = r"http[s]?://[a-zA-Z$-_!]+"
PHONE = rf"[\+]?[(]?[0-9]{{1,3}}[)]?[-{_SPACE_SET}\.]?[0-9]{{3}}[-{_SPACE_SET}\.]?[0-9]{{4,6}}"
HTML_TAG = "<[^>]+>"


def strip(text: Column) -> Column:
    """Drop white space on both ends."""
    return F.trim(text, F.lit(SPACE_CHARS))


# White space other than a blank, and a run of white space that is not one blank already.
_ODD_SPACE = f"[[^ -~]&&[{_SPACE_SET.replace('-' + chr(92) + 'x20', '-' + chr(92) + 'x1f')}]]"
UNEVEN_SPACE = f"[^!-~](?:(?<={_ODD_SPACE})|(?<= )(?={SPACE})){SPACE}*"


def blank_separated(text: Column) -> Column:
    """The text cut at each white space, with empty parts where some follow each other.

    Looking for single characters and cutting at one is much cheaper than a pattern.
    """
    blanks = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), SPACE_CHARS.replace(" ", ""), text)
    return F.split(blanks, " ")


def squeeze(text: Column) -> Column:
    """One blank for each run of white space, none on the ends.

    Looking for single characters is much cheaper than a pattern, so a text in which there
    are blanks only, one at a time, is left as it is.
    """

    def evened(t: Column) -> Column:
        odd = [F.contains(t, F.lit(c)) for c in ["  ", *SPACE_CHARS.replace(" ", "")]]
        return F.when(reduce(Column.__or__, odd), F.regexp_replace(t, UNEVEN_SPACE, " ")).otherwise(t)

    return F.trim(with_value(text, evened))


def _masked(text: Column, fixed: str, pattern: str, mask: str) -> Column:
    """The pattern's matches replaced; a cheap look for its fixed part goes before it, and
    the text is worked out once."""
    return with_value(text, lambda t: F.when(F.contains(t, F.lit(fixed)), F.regexp_replace(t, pattern, mask)).otherwise(t))


def clean_corpus(text: Column) -> Column:
    """Cleaning for training corpora: no tags, masked links and addresses, one line."""
    out = _masked(F.coalesce(text, F.lit("")), "<", HTML_TAG, "")
    out = _masked(out, "http", f"http[s]?://{NOT_SPACE}+", "[URL]")
    out = _masked(out, "www.", rf"www\.{NOT_SPACE}+", "[URL]")
    # An address swallows its whole run of non-blanks, so only run starts are tried.
    run_start = f"(?<!{NOT_SPACE})"
    out = _masked(out, "@", rf"{run_start}{NOT_SPACE}+@{NOT_SPACE}+\.{NOT_SPACE}+", "[EMAIL]")
    return squeeze(F.replace(out, F.lit("Â"), F.lit("")))


def clean_inference(text: Column) -> Column:
    """Cleaning before scoring: lower case, masked links, addresses and phones."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = _masked(out, "http", INFERENCE_URL, "[URL]")
    out = _masked(out, "@", EMAIL_ADDRESS, "[EMAIL]")
    out = F.regexp_replace(out, PHONE, "[PHONE]")
    return squeeze(out)


def concat_text(subject: Column, body: Column) -> Column:
    """Subject, blank, body; missing parts are empty."""
    return F.concat(F.coalesce(subject, F.lit("")), F.lit(" "), F.coalesce(body, F.lit("")))


def combine_subject_body(subject: Column, body: Column) -> Column:
    """'Subject: ...', empty line, body; the body alone without a subject."""
    return F.when(
        subject != "", F.concat(F.lit("Subject: "), subject, F.lit("\n\n"), body)
    ).otherwise(body)


def full_text(subject: Column, body: Column) -> Column:
    """Text the statistics and explanations look at."""
    return strip(concat_text(subject, body))


def words(text: Column) -> Column:
    """Lower-case words of at least two letters a-z."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def sentences(text: Column) -> Column:
    """Sentences of more than five characters."""
    return F.filter(F.transform(sentence_parts(text), strip), lambda s: F.char_length(s) > 5)


def sentence_parts(text: Column) -> Column:
    """The text cut at the white space behind full stops and the like."""
    return F.split(strip(text), f"(?<=[.!?]){SPACE}+")


def java_pattern(pattern: str) -> str:
    """Spell the shorthand classes of a rule pattern out as Unicode classes."""
    body = pattern
    if body.startswith(r"\b"):
        body = WORD_START + body[2:]
    if body.endswith(r"\b"):
        body = body[:-2] + WORD_END
    return (
        body.replace(r"\b", EDGE)
        .replace(r"\w", WORD_CHAR)
        .replace(r"\S", NOT_SPACE)
        .replace(r"\s", SPACE)
        .replace(r"\d", r"\p{Nd}")
        .replace(".*", "[^\\n]*")
    )


def any_of(patterns: list[str]) -> str:
    """One Java pattern for a list of patterns written with \\b, \\w, \\S and \\d."""
    return "|".join(f"(?:{java_pattern(p)})" for p in patterns)


def by_first_letter(patterns: list[str]) -> str:
    """Alternation of whole-word patterns without their edges, grouped by first letter.

    A text position then costs one branch per letter instead of one per pattern.
    """
    groups: dict[str, list[str]] = {}
    for pattern in patterns:
        body = pattern.removeprefix(r"\b").removesuffix(r"\b")
        groups.setdefault(body[0], []).append(java_pattern(body[1:]))
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in groups.items())
