"""Robustness: evasive variants of emails, detectors for them, and the outcome report.

Measures how well the detectors hold; variants are made and scored in one narrow pass.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsieve.functions.columns import as_column, contains_any, fixed_text, round4, sql_array, sql_text, text_array, with_value
from mailsieve.functions.text import java_pattern
from mailsieve.rules import robustness as R


def brand_variant(brand: str) -> str:
    """Brand with its first replaceable letter swapped for the first look-alike."""
    for letter in brand:
        if letter in R.LOOKALIKES:
            return brand.replace(letter, R.LOOKALIKES[letter][0], 1)
    return brand


def spoofed_spellings() -> list[tuple[str, str]]:
    """(spelling, brand) for each brand, letter and look-alike, in rule order."""
    return [
        (brand.replace(letter, other, 1), brand)
        for brand in R.BRANDS
        for letter, others in R.LOOKALIKES.items()
        if letter in brand
        for other in others
    ]


def _kept_part(spelling: str, brand: str) -> str:
    """The longer of the pieces of a brand before and after its replaced letter."""
    at = next((i for i, (a, b) in enumerate(zip(spelling, brand)) if a != b), len(brand))
    return max(brand[:at], brand[at + 1 :], key=len)


def detect_zero_width(text: Column) -> Column:
    return F.rlike(text, F.lit("[" + "".join(R.ZERO_WIDTH) + "]"))


def detect_homoglyph_brands(text: Column) -> Column:
    """Notes on brands spelled with look-alike characters."""
    rows = []
    for part, group in groupby(spoofed_spellings(), lambda x: _kept_part(*x)):
        each = [f"named_struct('spelling', {sql_text(s)}, 'brand', {sql_text(b)})" for s, b in group]
        rows.append(f"named_struct('part', {sql_text(part)}, 'spellings', array({', '.join(each)}))")
    # What all spellings of a group share is looked for once, and mostly settles them.
    table = F.expr(f"array({', '.join(rows)})")
    found = with_value(
        F.lower(text),
        lambda lower: F.flatten(
            F.transform(
                F.filter(table, lambda g: F.contains(lower, g["part"])),
                lambda g: F.filter(g["spellings"], lambda x: F.contains(lower, x["spelling"])),
            )
        ),
    )
    return F.transform(
        found,
        lambda x: F.concat(
            F.lit("Homoglyph brand spoof detected: '"), x["spelling"], F.lit("' (mimics '"),
            x["brand"], F.lit("')"),
        ),
    )


# A text without the word cannot match the prompt pattern at the same place of the list.
PROMPT_MARKS = ["instructions", " as ", "trust score", ":", "verified", "no ", "begin safe email"]


def detect_prompt_phrases(text: Column) -> Column:
    """Notes on prompt-style phrases."""

    def notes(lower: Column) -> Column:
        return F.array_compact(
            F.array(
                *[
                    F.when(
                        F.contains(lower, F.lit(mark)) & F.rlike(lower, F.lit(java_pattern(p))),
                        F.lit(note),
                    )
                    for (p, note), mark in zip(R.PROMPT_PATTERNS, PROMPT_MARKS, strict=True)
                ]
            )
        )

    return with_value(F.lower(text), notes)


def detect_url_obfuscation(url: Column) -> Column:
    """Notes on tricks in a URL."""
    host = F.when(F.contains(url, F.lit("/")), F.split_part(url, F.lit("/"), F.lit(3))).otherwise(url)
    ascii_host = F.when(F.contains(url, F.lit("//")), host).otherwise(url)
    below = F.regexp_extract(url, rf"({'|'.join(R.BRANDS)})\.com\.", 0)
    notes = [
        (F.rlike(url, F.lit(r"https?://[^/]+@")), "URL contains @ trick (credential/host confusion)"),
        (F.rlike(host, F.lit("%[0-9a-fA-F]{2}")), "Hex-encoded characters in domain"),
        (
            F.rlike(url, F.lit(r"^https?://\p{Nd}{1,3}(?:\.\p{Nd}{1,3}){3}")),
            "IP address used instead of domain name",
        ),
        (contains_any(url, R.SHORTENERS), "URL shortener detected"),
        (
            below != "",
            F.concat(F.lit("Subdomain deception: '"), below, F.lit("' prefix on external domain")),
        ),
        (
            F.rlike(ascii_host, F.lit(r"[^\x00-\x7f]")),
            "Non-ASCII (IDN/homoglyph) characters in domain",
        ),
        (F.rlike(url, F.lit(r"\.com//[^/]")), "Double-slash path confusion after domain"),
    ]
    return F.array_compact(F.array(*[F.when(hit, as_column(note)) for hit, note in notes]))


URL_LEAD = "Click here: "
ZERO_WIDTH_NOTE = "Zero-width character detected by heuristic layer"


def _variant(kind: str, name: Column | str, text: Column, probe: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("attack_type"),
        as_column(name).alias("variant_name"),
        text.alias("adversarial_text"),
        (probe if probe is not None else text).alias("_probe"),
    )


def _text() -> Column:
    return F.col("text")


def homoglyph_variants() -> list[Column]:
    """One variant per brand in the text (any case); NULL for the others."""
    lower = F.lower(_text())
    out = []
    for brand in R.BRANDS:
        spelled = brand_variant(brand)
        changed = F.replace(_text(), F.lit(brand), F.lit(spelled))
        out.append(
            F.when(
                F.contains(lower, F.lit(brand)),
                _variant("homoglyph", f"{brand} → {spelled}", changed),
            )
        )
    return out


def _hidden(text: Column, char: Column) -> Column:
    """The text with a character after every few of its own."""
    return F.regexp_replace(text, F.lit(rf"(?s)(.{{{R.ZERO_WIDTH_STEP}}})"), F.concat(F.lit("$1"), char))


def zero_width_variants(first: int | None = None) -> list[Column]:
    """An invisible character after every tenth character: all kinds, or the first ones."""
    out = []
    for char, name in list(R.ZERO_WIDTH.items())[:first]:
        changed = _hidden(_text(), F.lit(char))
        out.append(_variant("zero_width", f"Injected {name} every {R.ZERO_WIDTH_STEP} chars", changed))
    return out


def url_variants() -> list[Column]:
    """A disguised URL at the end; the detector looks at the URL."""
    return [
        _variant(
            "url_obfuscation",
            f"{plain[:40]} → {disguised[:40]}",
            F.concat(_text(), F.lit(f"\n\n{URL_LEAD}{disguised}")),
            F.lit(disguised),
        )
        for plain, disguised in R.DISGUISED_URLS
    ]


def phrase_variants() -> list[Column]:
    """A reassuring or commanding phrase in front."""
    return [
        _variant(
            "prompt_evasion",
            f'Prepended: "{phrase[:60]}…"',
            F.concat(F.lit(phrase + "\n\n"), _text()),
        )
        for phrase in R.EVASION_PHRASES
    ]


GENERATORS = {
    "homoglyph": homoglyph_variants,
    "zero_width": zero_width_variants,
    "url_obfuscation": url_variants,
    "prompt_evasion": phrase_variants,
}


def variants(df: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """All evasive variants of emails with at least ten characters. Narrow.

    Each email gives at most 30 rows, one per template.
    """
    made = [v for kind in (kinds or R.ATTACKS) for v in GENERATORS[kind]()]
    keep = df.filter(F.char_length("text") >= R.MIN_TEXT)
    others = [c for c in df.columns if c != "text"]
    rows = keep.select(*others, F.inline_outer(F.array_compact(F.array(*made))))
    return rows.filter(F.col("attack_type").isNotNull())


def detector_notes() -> Column:
    """Notes of the detector that belongs to the attack; empty if it saw nothing."""
    probe = F.col("_probe")
    seen = F.array(F.lit(ZERO_WIDTH_NOTE))
    none = F.array().cast("array<string>")
    kind = F.col("attack_type")
    return (
        F.when(kind == "homoglyph", detect_homoglyph_brands(probe))
        .when(kind == "zero_width", F.when(detect_zero_width(probe), seen).otherwise(none))
        .when(kind == "url_obfuscation", detect_url_obfuscation(probe))
        .otherwise(detect_prompt_phrases(probe))
    )


MISSED = {
    "homoglyph": "Homoglyph not caught by heuristic layer",
    "zero_width": "Zero-width character NOT detected by heuristic layer",
    "url_obfuscation": "URL obfuscation not caught by heuristic layer",
    "prompt_evasion": "Evasion phrase not caught by heuristic layer",
}


def _looked_at(spark: SparkSession, scorer) -> tuple[list[tuple], list[tuple]]:
    """(name, old, new, families, notes) of the URL and phrase templates, by a job of their own."""
    urls = [(f"{p[:40]} → {d[:40]}", d) for p, d in R.DISGUISED_URLS]
    phrases = [(f'Prepended: "{p[:60]}…"', p) for p in R.EVASION_PHRASES]
    table = spark.createDataFrame([(*t, i) for i, t in enumerate(urls + phrases)], "name string, new string, i int")
    lead = F.when(F.col("i") < len(urls), F.lit(URL_LEAD)).otherwise("")
    notes = F.when(F.col("i") < len(urls), detect_url_obfuscation(F.col("new"))).otherwise(
        detect_prompt_phrases(F.col("new"))
    )
    bits = scorer.families(F.concat(lead, "new"), F.lit(""))
    rows = table.select("i", "name", "new", bits.alias("bits"), notes.alias("notes")).collect()
    found = [(r.name, "", r.new, r.bits, r.notes) for r in sorted(rows, key=lambda r: r.i)]
    return found[: len(urls)], found[len(urls) :]


def variant_parts(df: DataFrame, scorer, kinds: list[str] | None = None) -> DataFrame:
    """As variants, scored: every part of a variant is looked at once per email.

    For scorers whose families of a text are those of its parts between line breaks, as
    RuleScorer's. A disguised URL or a phrase stands before or behind a line break, so the
    email and the template are looked at by themselves; the invisible characters are no
    letters, digits, blanks or line breaks, the classes that the rules know, and the email
    is looked at with one of them. Only brand variants are texts of their own. The email's
    text is put together with its template after the rows are made, and only if asked for.
    """
    kinds = kinds or R.ATTACKS
    keep = df.filter(F.char_length("text") >= R.MIN_TEXT)
    subject, text, none = F.col("_subject"), F.col("text"), F.array().cast("array<string>")
    first = next(iter(R.ZERO_WIDTH))
    head = F.substring_index(text, "\n", 1)
    rest = F.substring(text, F.char_length(head) + 2, F.char_length(text))
    empty = F.coalesce(subject, F.lit("")) == ""
    keep = keep.withColumn("_rest_bits", scorer.families(rest, F.lit("")))
    keep = keep.withColumn("_body_bits", scorer.families(head, F.lit("")).bitwiseOR(F.col("_rest_bits")))
    with_subject = scorer.families(head, subject).bitwiseOR(F.col("_rest_bits"))
    keep = keep.withColumns(
        {
            "_bits": F.when(empty, F.col("_body_bits")).otherwise(with_subject),
            "_hidden_bits": scorer.families(_hidden(text, F.lit(first)), subject),
            "_body_notes": detect_prompt_phrases(text),
        }
    )
    start = F.substring(text, 1, R.ZERO_WIDTH_STEP)
    urls, phrases = _looked_at(df.sparkSession, scorer)

    def row(kind: str, name: Column, old: Column, new: Column, bits: Column, notes: Column) -> Column:
        parts = {
            "attack_type": F.lit(kind), "variant_name": name, "_old": old, "_new": new,
            "_variant_bits": bits, "_notes": notes,
        }
        return F.struct(*[value.alias(column) for column, value in parts.items()])

    def listed(templates: list[tuple]) -> Column:
        names = ["name", "old", "new", "bits", "notes"]
        texts = []
        for t in templates:
            name, old, new, bits, notes = (*t, 0, [])[:5]
            values = [sql_text(name), sql_text(old), sql_text(new), str(bits), f"CAST({sql_array(notes)} AS array<string>)"]
            texts.append(f"named_struct({', '.join(f'{sql_text(n)}, {v}' for n, v in zip(names, values))})")
        return F.expr(f"array({', '.join(texts)})")

    def brand_row(t: Column) -> Column:
        changed = F.replace(text, t["old"], t["new"])
        return with_value(
            changed,
            lambda x: row("homoglyph", t["name"], t["old"], t["new"], scorer.families(x, subject), detect_homoglyph_brands(x)),
        )

    def hidden_row(t: Column) -> Column:
        # The first place where a character goes is looked at.
        seen = detect_zero_width(F.concat(start, F.when(F.char_length(start) == R.ZERO_WIDTH_STEP, t["new"]).otherwise("")))
        notes = F.when(seen, F.array(F.lit(ZERO_WIDTH_NOTE))).otherwise(none)
        return row("zero_width", t["name"], t["old"], t["new"], F.col("_hidden_bits"), notes)

    def url_row(t: Column) -> Column:
        return row("url_obfuscation", t["name"], t["old"], t["new"], F.col("_bits").bitwiseOR(t["bits"]), t["notes"])

    def phrase_row(t: Column) -> Column:
        own = F.when(empty, t["bits"]).otherwise(scorer.families(t["new"], subject))
        found = F.array_union(t["notes"], F.col("_body_notes"))
        ordered = F.filter(text_array([note for _, note in R.PROMPT_PATTERNS]), lambda n: F.array_contains(found, n))
        notes = F.when(F.size("_body_notes") == 0, t["notes"]).otherwise(ordered)
        return row("prompt_evasion", t["name"], t["old"], t["new"], own.bitwiseOR(F.col("_body_bits")), notes)

    brands = [(f"{b} → {brand_variant(b)}", b, brand_variant(b)) for b in R.BRANDS]
    made = {
        "homoglyph": F.transform(
            with_value(F.lower(text), lambda lower: F.filter(listed(brands), lambda t: F.contains(lower, t["old"]))),
            brand_row,
        ),
        "zero_width": F.transform(
            listed([(f"Injected {name} every {R.ZERO_WIDTH_STEP} chars", "", char) for char, name in R.ZERO_WIDTH.items()]),
            hidden_row,
        ),
        "url_obfuscation": F.transform(listed(urls), url_row),
        "prompt_evasion": F.transform(listed(phrases), phrase_row),
    }
    rows = keep.select("*", F.inline(F.concat(*[made[k] for k in kinds])))
    kind, new = F.col("attack_type"), F.col("_new")
    whole = (
        F.when(kind == "homoglyph", F.replace(text, F.col("_old"), new))
        .when(kind == "zero_width", _hidden(text, new))
        .when(kind == "url_obfuscation", F.concat(text, F.lit("\n\n" + URL_LEAD), new))
        .otherwise(F.concat(new, F.lit("\n\n"), text))
    )
    return rows.withColumns(
        {"adversarial_text": whole, "_p_variant": scorer.of_families(F.bit_count("_variant_bits"))}
    )


def robustness(df: DataFrame, scorer, kinds: list[str] | None = None) -> DataFrame:
    """One row per email and variant with scores before and after and the outcome.

    The scores are phishing probabilities, the confidences those of the winning class. A
    variant evades if the scorer no longer calls it phishing and the detector sees
    nothing. fooled_by_confidence is the same test on the winning-class confidence, which
    a two-class scorer can never fail. Narrow: base and variant are scored in the row.
    """
    base = df.withColumn("_subject", F.col("subject"))
    if hasattr(scorer, "families"):
        rows = variant_parts(base, scorer, kinds)
        rows = rows.withColumn("_p_original", scorer.of_families(F.bit_count("_bits")))
    else:
        rows = variants(scorer.score(base, out="_p_original"), kinds)
        rows = scorer.score(rows, text="adversarial_text", subject="_subject", out="_p_variant")
        rows = rows.withColumn("_notes", detector_notes())

    def confidence(p: str) -> Column:
        return F.greatest(F.col(p), F.lit(1.0) - F.col(p))

    caught = F.size("_notes") > 0
    missed = F.element_at(
        F.create_map(*[F.lit(x) for pair in MISSED.items() for x in pair]), F.col("attack_type")
    )
    resilient = F.when(F.col("attack_type") == "homoglyph", "Classifier still confident: ").otherwise(
        "Classifier resilient: "
    )
    fooled = F.col("_p_variant") < 0.5
    percent = F.concat(fixed_text(confidence("_p_variant") * 100, 1), F.lit("%"))
    notes = F.concat(
        F.when(caught, F.col("_notes")).otherwise(F.array(missed)),
        F.array_compact(F.array(F.when(~fooled, F.concat(resilient, percent)))),
    )
    return rows.select(
        "email_id",
        "attack_type",
        "variant_name",
        "adversarial_text",
        round4(F.col("_p_original")).alias("original_score"),
        round4(F.col("_p_variant")).alias("adversarial_score"),
        round4(F.col("_p_variant") - F.col("_p_original")).alias("score_delta"),
        round4(confidence("_p_original")).alias("original_confidence"),
        round4(confidence("_p_variant")).alias("adversarial_confidence"),
        caught.alias("heuristic_caught"),
        fooled.alias("classifier_fooled"),
        (confidence("_p_variant") < 0.5).alias("fooled_by_confidence"),
        (fooled & ~caught).alias("evasion_success"),
        notes.alias("detection_notes"),
    )


def attack_breakdown(results: DataFrame) -> DataFrame:
    """Tested and evaded per attack type, 0 where an attack had no variant."""
    counts = [
        F.struct(
            F.lit(kind).alias("attack_type"),
            F.count_if(F.col("attack_type") == kind).alias("tested"),
            F.count_if((F.col("attack_type") == kind) & F.col("evasion_success")).alias("evaded"),
        )
        for kind in R.ATTACKS
    ]
    return results.agg(F.array(*counts).alias("kinds")).select(F.inline("kinds"))


def robustness_report(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals, evasion rate, resilience, breakdown per attack and summary line."""
    breakdown = F.map_from_arrays(
        F.array(*[F.lit(k) for k in R.ATTACKS]),
        F.array(
            *[
                F.struct(
                    F.count_if(F.col("attack_type") == k).alias("tested"),
                    F.count_if((F.col("attack_type") == k) & F.col("evasion_success")).alias("evaded"),
                )
                for k in R.ATTACKS
            ]
        ),
    )
    totals = results.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total_tests"),
        F.count_if("evasion_success").alias("evasion_successes"),
        breakdown.alias("attack_breakdown"),
    )
    rate = round4(F.coalesce(F.try_divide("evasion_successes", "total_tests"), F.lit(0.0)))
    totals = totals.withColumn("evasion_rate", rate)
    totals = totals.withColumn("resilience_score", round4(F.lit(1.0) - F.col("evasion_rate")))
    resilience = F.col("resilience_score")
    percent = F.concat(F.bround(resilience * 100, 0).cast("int").cast("string"), F.lit("%"))
    evaded = F.concat(F.col("evasion_successes").cast("string"), F.lit("/"), F.col("total_tests").cast("string"))
    summary = (
        F.when(
            resilience >= 0.90,
            F.concat(
                F.lit("Strong adversarial resilience ("), percent, F.lit(") — "), evaded,
                F.lit(" attack variants evaded detection."),
            ),
        )
        .when(
            resilience >= 0.70,
            F.concat(
                F.lit("Moderate resilience ("), percent, F.lit(") — "), evaded,
                F.lit(" variants evaded. Heuristic hardening recommended."),
            ),
        )
        .otherwise(
            F.concat(
                F.lit("Low resilience ("), percent, F.lit(") — "), evaded,
                F.lit(" variants evaded. Significant hardening required."),
            )
        )
    )
    return totals.withColumn("summary", summary)
