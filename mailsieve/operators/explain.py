"""Explanation layer: risk families, word attribution, top words, readable text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.functions.columns import round4, with_value
from mailsieve.functions.text import (
    EDGE,
    SPACE,
    WORD_END,
    WORD_START,
    any_of,
    blank_separated,
    by_first_letter,
    full_text,
    java_pattern,
    strip,
)
from mailsieve.rules import explain as R


def _word_patterns() -> list[str]:
    return [p for family in R.WORD_FAMILIES for p in R.FAMILIES[family]]


def risk_phrases(lower: Column) -> Column:
    """Every phrase of the word families in lower-case text, one per line, in text order.

    One pass over the text for all families. The match has no width, so phrases that
    overlap are all found; no two patterns match at the same place.
    """
    # The plain look-behind settles most places; the full one is left to the matches.
    scan = f"(?<![a-z])(?=({by_first_letter(_word_patterns())}){WORD_END}){WORD_START}"
    return F.array_join(F.regexp_extract_all(lower, F.lit(scan), F.lit(1)), "\n")


def family_hit(phrases: Column, family: str) -> Column:
    """True if any pattern of a word family is among the phrases."""
    return F.rlike(phrases, F.lit(any_of(R.FAMILIES[family])))


def url_family_hit(lower: Column) -> Column:
    """True if a pattern of the URL family is in lower-case text.

    A cheap look for the fixed part of each pattern goes before the pattern itself.
    """
    link, click, below, following, button = (
        F.lit(x) for x in ("link", "click", "below", "following link", "button below")
    )
    url, clicks, belows, followings, buttons = (
        F.rlike(lower, F.lit(java_pattern(p))) for p in R.FAMILIES["suspicious_url"]
    )
    linked = F.contains(lower, link) & (
        (F.contains(lower, click) & clicks)
        | (F.contains(lower, below) & belows)
        | (F.contains(lower, following) & followings)
    )
    return (
        (F.contains(lower, F.lit("http")) & url) | linked | (F.contains(lower, button) & buttons)
    )


def categories_from(phrases: Column, lower: Column) -> Column:
    """Families in fixed order, from the phrases and the text they were found in."""
    hits = {f: family_hit(phrases, f) for f in R.WORD_FAMILIES}
    hits["suspicious_url"] = url_family_hit(lower)
    return F.array_compact(F.array(*[F.when(hits[f], F.lit(f)) for f in R.FAMILIES]))


def family_bits(text: Column) -> Column:
    """The families found in a text as bits of a number, in the order of the rules.

    No pattern crosses a line break, and a line break is no word character, so the bits of
    texts put together by line breaks are those of either.
    """

    def bits(phrases: Column, lower: Column) -> Column:
        hits = {f: family_hit(phrases, f) for f in R.WORD_FAMILIES}
        hits["suspicious_url"] = url_family_hit(lower)
        marks = [F.when(hits[f], F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(R.FAMILIES)]
        return reduce(lambda a, b: a.bitwiseOR(b), marks)

    return with_value(F.lower(text), lambda lower: with_value(risk_phrases(lower), lambda p: bits(p, lower)))


def with_risk_phrases(df: DataFrame, text: Column) -> DataFrame:
    """Add _lower and _phrases, each worked out once per row."""
    base = df.withColumn("_lower", F.lower(text))
    return base.withColumn("_phrases", risk_phrases(F.col("_lower")))


def with_risk_categories(df: DataFrame, text: Column, out: str = "risk_categories") -> DataFrame:
    """Add the families found in a text. Narrow."""
    base = with_risk_phrases(df, text)
    return base.withColumn(out, categories_from(F.col("_phrases"), F.col("_lower"))).drop(
        "_lower", "_phrases"
    )


def clean_token(token: Column) -> Column:
    """Token without anything but letters, digits and underscores, lower case."""
    return F.lower(F.regexp_replace(token, rf"[^\p{{L}}\p{{N}}_]", ""))


def first_matches(phrases: Column) -> Column:
    """First match of each word pattern, from the phrases in text order."""
    each = F.array(*[F.regexp_extract(phrases, java_pattern(p), 0) for p in _word_patterns()])
    none = F.array().cast("array<string>")
    return F.when(phrases != "", F.array_remove(each, "")).otherwise(none)


def word_pattern() -> str:
    """Pattern of a clean token that is itself a risk word; it holds word characters only."""
    return rf"\A(?:{by_first_letter(_word_patterns())})\z"


def with_tokens(df: DataFrame) -> DataFrame:
    """Add _full, and tokens: array of (pos, token, clean, rule) in text order. Narrow."""
    base = df.withColumn("_full", full_text(F.col("subject"), F.col("text")))
    base = with_risk_phrases(base, F.col("_full"))
    base = base.withColumn("_matches", first_matches(F.col("_phrases")))
    base = base.withColumn("_joined", F.array_join("_matches", "\n"))
    raw = F.filter(blank_separated(F.col("_full")), lambda t: t != "")
    base = base.withColumn(
        "_clean",
        F.transform(raw, lambda t, i: F.struct(i.alias("pos"), t.alias("token"), clean_token(t).alias("clean"))),
    )
    pattern = F.lit(word_pattern())

    def rule_score(clean: Column) -> Column:
        # A clean token holds no line break, so it is in one of them.
        inside = F.contains(F.col("_joined"), clean)
        return (
            F.when(F.rlike(clean, pattern), F.lit(R.WORD_SCORE))
            .when((F.size("_matches") > 0) & inside, F.lit(R.PHRASE_SCORE))
            .otherwise(F.lit(R.BASE_SCORE))
        )

    return base.withColumn(
        "tokens",
        F.transform(
            "_clean",
            lambda t: F.struct(
                t["pos"].alias("pos"),
                t["token"].alias("token"),
                t["clean"].alias("clean"),
                rule_score(t["clean"]).alias("rule"),
            ),
        ),
    ).drop("_matches", "_joined", "_clean", "_phrases", "_lower")


def weight_key(token: Column) -> Column:
    """Key of a token in the table of model weights."""
    return F.ltrim(F.lower(token), F.lit("#"))


def normalise(tokens: Column, raw_max: Column) -> Column:
    """(pos, token, clean, raw_score, score, is_highlighted) from tokens with raw_score."""
    top = F.when(raw_max == 0, F.lit(1.0)).otherwise(raw_max)

    # The score is a step of its own, so that it is not worked out again for the mark.
    scored = F.transform(tokens, lambda t: F.struct(t.alias("t"), round4(t["raw_score"] / top).alias("score")))
    return F.transform(
        scored,
        lambda x: F.struct(
            x["t"]["pos"].alias("pos"),
            x["t"]["token"].alias("token"),
            x["t"]["clean"].alias("clean"),
            x["t"]["raw_score"].alias("raw_score"),
            x["score"].alias("score"),
            (x["score"] >= R.HIGHLIGHT_AT).alias("is_highlighted"),
        ),
    )


def attribute_tokens(df: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Add ``tokens`` with raw and normalised scores to rows of email_id, subject, text.

    weights (email_id, pos, token, score) holds whole-word weights of a model. They are gathered to
    one map per email, as long as the email itself, and blended 60:40 with the rule score;
    a word without weight counts half its rule score. Emails without weights use the rules.
    The tokens, ordered by key, meet the map once as a whole: a look into a map goes through
    its keys one by one, so one per token would cost the square of an email's words.
    """
    base = with_tokens(df)
    if weights is None:
        blended = F.transform("tokens", lambda t: _raw(t, t["rule"]))
    else:
        maps = (
            weights.groupBy("email_id", weight_key(F.col("token")).alias("k"))
            .agg(F.max_by("score", "pos").alias("w"))
            .groupBy("email_id")
            .agg(F.map_from_entries(F.collect_list(F.struct("k", "w"))).alias("_weights"))
        )
        base = _with_token_weights(base.join(maps, "email_id", "left"))

        def mixed(t: Column, w: Column) -> Column:
            return _raw(t, round4(F.coalesce(w, t["rule"] * 0.5) * 0.6 + t["rule"] * 0.4))

        blended = F.when(
            F.col("_weights").isNull(), F.transform("tokens", lambda t: _raw(t, t["rule"]))
        ).otherwise(F.zip_with("tokens", "_token_weights", mixed))
    base = base.withColumn("_blended", blended)
    raw_max = F.array_max(F.transform("_blended", lambda t: t["raw_score"]))
    base = base.withColumn("_max", raw_max)
    return base.withColumn("tokens", normalise(F.col("_blended"), F.col("_max"))).drop(
        "_blended", "_max", "_weights", "_token_weights"
    )


def _with_token_weights(df: DataFrame) -> DataFrame:
    """Add _token_weights, the value of the map _weights for each of tokens, in their order.

    Places of the tokens are sorted by key, so those of a key are one stretch, and the
    stretches meet the map by hash.
    """
    places = F.transform("tokens", lambda t: F.struct(weight_key(t["token"]).alias("k"), t["pos"].alias("pos")))
    base = df.withColumn("_places", F.sort_array(places))
    marked = F.transform(
        "_places", lambda p, i: F.struct(p["k"].alias("k"), i.alias("at"), (F.get("_places", i - 1)["k"] == p["k"]).alias("same"))
    )
    base = base.withColumn("_heads", F.filter(marked, lambda h: F.coalesce(~h["same"], F.lit(True))))
    stretches = F.transform(
        "_heads",
        lambda h, i: F.struct(
            h["k"], F.struct(h["at"].alias("lo"), F.coalesce(F.get("_heads", i + 1)["at"], F.size("_places")).alias("hi"))
        ),
    )
    both = F.map_zip_with(F.map_from_entries(stretches), "_weights", lambda k, s, w: F.struct(s.alias("s"), w.alias("w")))
    base = base.withColumn("_met", F.filter(F.map_values(both), lambda x: x["s"].isNotNull()))
    weighed = F.transform(
        "_met",
        lambda x: F.transform(
            F.sequence(x["s"]["lo"], x["s"]["hi"] - 1),
            lambda i: F.struct(F.get("_places", i)["pos"].alias("pos"), x["w"].alias("w")),
        ),
    )
    in_order = F.transform(F.sort_array(F.flatten(weighed)), lambda x: x["w"])
    return base.withColumn("_token_weights", in_order).drop("_places", "_heads", "_met")


def _raw(token: Column, score: Column) -> Column:
    return F.struct(
        token["pos"].alias("pos"),
        token["token"].alias("token"),
        token["clean"].alias("clean"),
        score.alias("raw_score"),
    )


def top_tokens(df: DataFrame, n: int = R.TOP_TOKENS) -> DataFrame:
    """Add ``top_tokens``: first spelling of the n best distinct highlighted words.

    Ordered by score, then position; all inside the row.
    """
    good = F.filter("tokens", lambda t: t["is_highlighted"] & (F.char_length(t["clean"]) > 2))
    ranked = F.sort_array(
        F.transform(
            good,
            lambda t: F.struct(
                (-t["score"]).alias("rank"), t["pos"].alias("pos"), t["token"].alias("token"),
                t["clean"].alias("clean"),
            ),
        )
    )
    base = df.withColumn("_ranked", ranked)
    base = base.withColumn("_cleans", F.transform("_ranked", lambda t: t["clean"]))
    best = F.slice(F.array_distinct("_cleans"), 1, n)
    return base.withColumn(
        "top_tokens",
        F.transform(
            best,
            lambda c: F.element_at("_ranked", F.array_position("_cleans", c).cast("int"))["token"],
        ),
    ).drop("_ranked", "_cleans")


def merge_wordpieces(pieces: DataFrame) -> DataFrame:
    """Join '##' continuations to their word; score is the best of the pieces.

    pieces: email_id, pos, token, score. Neighbouring pieces of an email are packed to one
    row of arrays before the shuffle; an email's pieces are then sorted and cut into words
    inside its row. Pieces at the same place open their words together.
    """
    continues = F.coalesce(F.startswith("token", F.lit("##")), F.lit(False))
    text = F.when(continues, F.substring("token", 3, 1 << 30)).otherwise(F.col("token"))
    flat = pieces.select("email_id", "pos", continues.alias("continues"), text.alias("t"), "score")
    key, *names = flat.columns
    kinds = dict(flat.dtypes)
    packed = flat.mapInArrow(
        pack_neighbours(), f"{key} {kinds[key]}" + "".join(f", {c} array<{kinds[c]}>" for c in names)
    )
    # Dealt out as they are: to combine them before would sort every piece once more.
    dealt = packed.repartition(key).groupBy(key).agg(F.collect_list(F.struct(*names)).alias("_packs"))
    every = F.flatten(F.transform("_packs", lambda p: F.arrays_zip(*[p[c] for c in names])))
    rows = dealt.select("email_id", F.sort_array(every).alias("_pieces"))
    marked = F.transform("_pieces", lambda x, i: F.struct(i.alias("at"), x["pos"].alias("pos"), (~x["continues"]).alias("opens")))
    opens = F.transform(
        F.filter(marked, lambda x: x["opens"]), lambda x, i: F.struct(x["at"].alias("at"), x["pos"].alias("pos"), (i + 1).alias("no"))
    )
    rows = rows.withColumn("_opens", opens)

    def other(i: Column, j: Column) -> Column:
        """No word opens at j, or at another place than at i."""
        outside = (j < 0) | (j >= F.size("_opens"))
        return outside | ~F.get("_opens", j)["pos"].eqNullSafe(F.get("_opens", i)["pos"])

    # Of the words that open at one place, the first begins there and the last gives the number.
    rows = rows.withColumns(
        {
            "_firsts": F.filter("_opens", lambda x, i: other(i, i - 1)),
            "_lasts": F.filter("_opens", lambda x, i: other(i, i + 1)),
        }
    )
    first_at = F.coalesce(F.get("_firsts", F.lit(0))["at"], F.size("_pieces"))
    begins = F.concat(
        F.when(first_at > 0, F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("no")))).otherwise(
            F.array().cast("array<struct<at:int,no:int>>")
        ),
        F.zip_with("_firsts", "_lasts", lambda f, z: F.struct(f["at"].alias("at"), z["no"].alias("no"))),
    )
    rows = rows.withColumn("_begins", begins)

    def word(begin: Column, i: Column) -> Column:
        end = F.coalesce(F.get("_begins", i + 1)["at"], F.size("_pieces"))
        own = F.slice("_pieces", begin["at"] + 1, end - begin["at"])
        return F.struct(begin["no"].cast("bigint").alias("word_no"), own.alias("own"))

    words = rows.select("email_id", F.inline(F.transform("_begins", word)))
    in_order = F.sort_array(F.transform("own", lambda x: F.struct(x["pos"], x["t"])))
    return words.select(
        "email_id",
        "word_no",
        F.array_min(F.transform("own", lambda x: x["pos"])).alias("pos"),
        F.array_join(F.transform(in_order, lambda x: x["t"]), "").alias("token"),
        F.array_max(F.transform("own", lambda x: x["score"])).alias("score"),
    ).filter(F.col("token") != "")


def pack_neighbours() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Function that makes rows of one key that follow each other one row: the key, then a
    list per column. Made here, so that it is shipped with the job."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            key, *columns = batch.columns
            differs = pc.fill_null(pc.not_equal(key.slice(1), key.slice(0, n - 1)), True)
            heads = np.concatenate([[0], np.flatnonzero(differs.to_numpy(zero_copy_only=False)) + 1])
            offsets = pa.array(np.append(heads, n), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, c) for c in columns]
            yield pa.RecordBatch.from_arrays([key.take(pa.array(heads)), *lists], batch.schema.names)

    return pack


def without_token(text: Column, token: Column) -> Column:
    """Text without the whole-word occurrences of a token, any case, blanks squeezed."""
    quoted = F.regexp_replace(token, r"([^\p{L}\p{N}_])", r"\\$1")
    pattern = F.concat(F.lit(f"(?iu){EDGE}"), quoted, F.lit(EDGE))
    removed = F.regexp_replace(text, pattern, F.lit(""))
    return strip(F.regexp_replace(removed, f"{SPACE}{{2,}}", " "))


def ablate_top_token(df: DataFrame, scorer) -> DataFrame:
    """Add ``top_token_confidence_delta`` to rows with top_tokens, subject and text.

    The full text and the text without its top token are both scored in the same row, so
    nothing is joined back. 0 where the email is not phishing or has no top token.
    """
    top = F.get("top_tokens", F.lit(0))
    base = df.withColumn("_full", full_text(F.col("subject"), F.col("text")))
    base = base.withColumn(
        "_ablated", F.when(top.isNotNull(), without_token(F.col("_full"), top)).otherwise("")
    )
    base = scorer.score(base, text="_full", subject=None, out="_p_full")
    base = scorer.score(base, text="_ablated", subject=None, out="_p_ablated")

    def confidence(p: str) -> Column:
        return F.greatest(F.col(p), F.lit(1.0) - F.col(p))

    delta = round4(confidence("_p_full") - confidence("_p_ablated"))
    return base.withColumn(
        "top_token_confidence_delta",
        F.when(F.col("is_phishing") & top.isNotNull(), delta).otherwise(F.lit(0.0)),
    ).drop("_full", "_ablated", "_p_full", "_p_ablated")


def explain(df: DataFrame, named_tokens: int = 5) -> DataFrame:
    """Add explanation and summary to rows with risk_categories, top_tokens, is_phishing
    and confidence. The texts name the first named_tokens words. Narrow."""
    labels = F.create_map(*[F.lit(x) for pair in R.LABELS.items() for x in pair])
    quoted = F.array_join(
        F.transform(F.slice("top_tokens", 1, named_tokens), lambda t: F.concat(F.lit('"'), t, F.lit('"'))),
        ", ",
    )
    percent = F.concat(F.bround(F.col("confidence") * 100, 0).cast("int").cast("string"), F.lit("%"))
    has_tokens = F.size("top_tokens") > 0
    has_categories = F.size("risk_categories") > 0
    named = F.array_join(F.transform("risk_categories", lambda c: F.element_at(labels, c)), " + ")
    parts = F.array_compact(
        F.array(
            F.when(has_categories, F.concat(F.lit("flagged because: "), named)),
            F.when(has_tokens, F.concat(F.lit("key trigger words: "), quoted)),
        )
    )
    found = F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise("high phishing signal")
    lines = F.array_compact(
        F.array(
            F.concat(
                F.lit("The model classified this email as PHISHING with "), percent,
                F.lit(" confidence."),
            ),
            *[
                F.when(F.array_contains("risk_categories", f), F.lit(R.EXPLANATIONS[f]))
                for f in R.FAMILIES
            ],
            F.when(
                has_tokens, F.concat(F.lit("• Highest-attribution tokens: "), quoted, F.lit("."))
            ),
        )
    )
    legit = F.concat(
        F.lit("The model classified this email as LEGITIMATE with "), percent,
        F.lit(" confidence. No significant urgency language, credential requests, or suspicious "
              "patterns were found."),
    )
    return df.withColumns(
        {
            "explanation": F.when(F.col("is_phishing"), F.array_join(lines, "\n")).otherwise(legit),
            "summary": F.when(
                F.col("is_phishing"), F.concat(F.lit("Flagged: "), found)
            ).otherwise("Email appears legitimate — no strong phishing signals detected."),
        }
    )
