"""Small helpers to turn rule tables into columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """A condition with the flag it raises and the points it adds (hundredths)."""

    when: Column
    flag: Column | str
    points: Column | int = 0


def sql_text(value: str) -> str:
    """String literal of Spark SQL."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def sql_array(values: Iterable[str]) -> str:
    return f"array({', '.join(sql_text(v) for v in values)})"


def text_array(values: Iterable[str]) -> Column:
    """Constant array of strings."""
    return F.expr(sql_array(values))


def in_set(text: Column, values: Iterable[str]) -> Column:
    return F.array_contains(text_array(values), text)


def as_column(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def with_value(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, also where a lambda uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def contained(text: Column, phrases: Sequence[str]) -> Column:
    """The phrases found in the text, in the order of the list."""
    return with_value(
        text, lambda t: F.filter(text_array(phrases), lambda p: F.contains(t, p))
    )


def first_contained(text: Column, phrases: Sequence[str]) -> Column:
    """First phrase of the list found in the text, or NULL."""
    return F.get(contained(text, phrases), F.lit(0))


def contains_any(text: Column, phrases: Sequence[str]) -> Column:
    return F.rlike(text, F.lit("|".join(re.escape(p) for p in phrases)))


def ending(text: Column, endings: Sequence[str]) -> Column:
    """The ending of the list that closes the text, or '' (endings start with a dot)."""
    choices = "|".join(re.escape(e) for e in endings)
    return F.regexp_extract(text, rf"({choices})\z", 1)


def in_domains(domain: Column, domains: Sequence[str]) -> Column:
    """True if the domain is one of the list or below one of them."""
    choices = "|".join(re.escape(d) for d in domains)
    return F.rlike(domain, F.lit(rf"(?:^|\.)(?:{choices})\z"))


def flags_of(rules: Sequence[Rule]) -> Column:
    """Flags of the rules that hold, in rule order."""
    return F.array_compact(F.array(*[F.when(r.when, as_column(r.flag)) for r in rules]))


def points_of(rules: Sequence[Rule]) -> Column:
    """Sum of the points of the rules that hold."""
    total = F.lit(0)
    for rule in rules:
        if isinstance(rule.points, int) and rule.points == 0:
            continue
        points = F.lit(rule.points) if isinstance(rule.points, int) else rule.points
        total = total + F.when(rule.when, points).otherwise(0)
    return total


def score_of(points: Column) -> Column:
    """Points in hundredths to a score between 0 and 1."""
    return F.least(points, F.lit(100)).cast("double") / F.lit(100.0)


def round_to(value: Column, digits: int) -> Column:
    """Nearest multiple of 10**-digits to the exact binary value, ties to the even digit.

    digits is at most 7. value * 10**digits is rounded once by the machine; its error is
    worked out exactly from the two halves of value (Veltkamp, Dekker) and settles the
    cases that look like ties.
    """
    scale = F.lit(10.0**digits)
    x = F.abs(value)
    wide = x * F.lit(134217729.0)
    high = wide - (wide - x)
    low = x - high
    product = x * scale
    error = (high * scale - product) + low * scale
    whole = F.floor(product).cast("double")
    part = product - whole
    tie = (error > 0) | ((error == 0) & (whole % F.lit(2.0) == 1))
    up = (part > 0.5) | ((part == 0.5) & tie)
    return F.signum(value) * ((whole + up.cast("double")) / scale)


def round4(value: Column) -> Column:
    return round_to(value, 4)


def fixed_text(value: Column, digits: int) -> Column:
    """The value with so many decimals, rounded as round_to does."""
    return F.format_string(f"%.{digits}f", round_to(value, digits))


def leading(values: Column, n: int | None) -> Column:
    """First n elements; all of them without n."""
    return values if n is None else F.slice(values, 1, n)


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def title_case(text: Column) -> Column:
    """First letter upper case (for one-word brand names)."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))
