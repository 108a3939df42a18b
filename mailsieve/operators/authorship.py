"""Authorship statistics per email, computed inside the row: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.functions.columns import clamp01, contained, fixed_text, round4
from mailsieve.functions.text import full_text, sentence_parts, sentences, strip, words
from mailsieve.rules import authorship as R


def sentence_lengths(text: Column) -> Column:
    """Words per sentence, in order."""
    return F.transform(sentences(text), lambda s: F.size(words(s)))


def mean_length(lengths: Column) -> Column:
    total = F.aggregate(lengths, F.lit(0), lambda a, x: a + x)
    return F.try_divide(total, F.size(lengths))


def burstiness_score(lengths: Column, mean: Column) -> Column:
    """1 for even sentence lengths, 0 for bursty ones; .5 with fewer than three sentences.

    The mean is a column of its own, so that it is not worked out again per sentence.
    """
    return _burstiness(F.size(lengths), mean, length_spread(lengths, mean))


def length_spread(lengths: Column, mean: Column) -> Column:
    """Standard deviation of the sentence lengths."""
    n = F.size(lengths)
    return F.sqrt(
        F.aggregate(
            lengths,
            F.lit(0.0),
            lambda a, x: a + (x - mean) * (x - mean),
            lambda a: F.try_divide(a, n),
        )
    )


def _burstiness(n: Column, mean: Column, spread: Column) -> Column:
    burst = F.try_divide(spread - mean, spread + mean)
    return F.when((n < 3) | burst.isNull(), F.lit(0.5)).otherwise(
        round4(clamp01(F.lit(0.3) - burst))
    )


def run_starts(ordered: Column) -> Column:
    """Places where a new value begins in a sorted array."""
    last = F.size(ordered) - 1
    return F.filter(
        F.sequence(F.lit(0), last),
        lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
    )


def entropy_bits(counts: Column, total: Column) -> Column:
    """Unigram entropy from the word counts of one text."""
    return F.aggregate(
        counts, F.lit(0.0), lambda a, c: a - (c / total) * F.log2(c / total)
    )


def with_word_columns(df: DataFrame) -> DataFrame:
    """Add the token columns the statistics below are made of."""
    base = df.withColumn("_full", full_text(F.col("subject"), F.col("text")))
    # Words are cut once, sentence by sentence, as none goes over white space. They are
    # counted by their 64-bit hashes: numbers sort and meet many times faster.
    parts = F.transform(
        sentence_parts(F.col("_full")),
        lambda s: F.struct(F.char_length(strip(s)).alias("chars"), F.transform(words(s), lambda w: F.xxhash64(w)).alias("words")),
    )
    base = base.withColumn("_parts", parts)
    base = base.withColumn("_words", F.flatten(F.transform("_parts", lambda p: p["words"])))
    base = base.withColumns({"_n": F.size("_words"), "_sorted": F.sort_array("_words")})
    base = base.withColumn(
        "_starts",
        F.when(F.col("_n") > 0, run_starts(F.col("_sorted"))).otherwise(
            F.array().cast("array<int>")
        ),
    )
    ends = F.concat(
        F.slice("_starts", 2, F.greatest(F.size("_starts") - 1, F.lit(0))), F.array("_n")
    )
    pairs = F.zip_with(
        F.slice("_words", 1, F.greatest(F.col("_n") - 1, F.lit(0))),
        F.slice("_words", 2, F.greatest(F.col("_n") - 1, F.lit(0))),
        lambda a, b: F.xxhash64(a, b),
    )
    return base.withColumns(
        {
            "_counts": F.when(F.col("_n") > 0, F.zip_with("_starts", ends, lambda a, b: b - a)),
            "_pairs": F.size(F.array_distinct(pairs)),
            "_lengths": F.transform(
                F.filter("_parts", lambda p: p["chars"] > 5), lambda p: F.size(p["words"])
            ),
        }
    ).withColumn("_mean", F.when(F.size("_lengths") > 0, mean_length(F.col("_lengths"))))


_WORK = ["_full", "_parts", "_words", "_n", "_sorted", "_starts", "_counts", "_pairs", "_lengths", "_mean"]


def perplexity_score(bits: Column | None = None) -> Column:
    bits = entropy_bits(F.col("_counts"), F.col("_n")) if bits is None else bits
    return F.when(F.col("_n") < 10, F.lit(0.5)).otherwise(
        round4(clamp01((F.lit(9.0) - bits) / F.lit(5.0)))
    )


def vocabulary_score() -> Column:
    ttr = F.try_divide(F.size("_starts"), F.sqrt(F.col("_n")))
    return F.when(F.col("_n") < 5, F.lit(0.5)).otherwise(
        round4(clamp01((F.lit(7.0) - ttr) / F.lit(5.0)))
    )


def repetition_score() -> Column:
    share = F.lit(1.0) - F.try_divide(F.col("_pairs"), F.col("_n") - 1)
    return F.when(F.col("_n") < 4, F.lit(0.0)).otherwise(round4(clamp01(share / F.lit(0.4))))


def formality_hits() -> Column:
    lower = F.lower("_full")
    return F.size(contained(lower, R.CONNECTORS + R.URGENCY))


def formality_score() -> Column:
    per_hundred = F.try_divide(F.col("_hits"), F.col("_n")) * F.lit(100.0)
    return F.when(F.col("_n") == 0, F.lit(0.0)).otherwise(
        round4(clamp01(per_hundred / F.lit(8.0)))
    )


def authorship(df: DataFrame) -> DataFrame:
    """Add a struct column ``authorship`` to rows with subject and text. Narrow.

    Texts with fewer than ten words score 0.
    """
    # Rounding names its value many times over; what goes through a whole array is a column
    # of its own before that, so that it is worked out once.
    base = with_word_columns(df).withColumns(
        {
            "_hits": formality_hits(),
            "_bits": entropy_bits(F.col("_counts"), F.col("_n")),
            "_spread": length_spread(F.col("_lengths"), F.col("_mean")),
        }
    )
    scored = base.withColumns(
        {
            "_b": _burstiness(F.size("_lengths"), F.col("_mean"), F.col("_spread")),
            "_p": perplexity_score(F.col("_bits")),
            "_v": vocabulary_score(),
            "_r": repetition_score(),
            "_f": formality_score(),
        }
    )
    w = R.WEIGHTS
    mix = (
        F.col("_b") * F.lit(w["burstiness"])
        + F.col("_p") * F.lit(w["perplexity"])
        + F.col("_v") * F.lit(w["vocabulary"])
        + F.col("_r") * F.lit(w["repetition"])
        + F.col("_f") * F.lit(w["formality"])
    )
    scored = scored.withColumn("_score", round4(F.least(F.lit(1.0), mix)))
    scored = scored.withColumn("_ai", F.col("_score") >= R.WRITTEN_BY_AI_AT)
    short = F.col("_n") < R.MIN_WORDS

    def long_only(column: str) -> Column:
        return F.when(short, F.lit(0.0)).otherwise(F.col(column))

    result = F.struct(
        (~short & F.col("_ai")).alias("is_ai_generated"),
        long_only("_score").alias("ai_authorship_score"),
        long_only("_b").alias("burstiness_score"),
        long_only("_p").alias("perplexity_proxy"),
        long_only("_v").alias("vocabulary_richness"),
        long_only("_r").alias("repetition_score"),
        long_only("_f").alias("formality_score"),
        F.when(short, F.array(F.lit("Text too short for reliable AI authorship analysis")))
        .otherwise(_signals())
        .alias("signals"),
    )
    return scored.withColumn("authorship", result).drop(
        *_WORK, "_hits", "_bits", "_spread", "_b", "_p", "_v", "_r", "_f", "_score", "_ai"
    )


def _signals() -> Column:
    """Readable signals of the parts above their lines."""

    def strong(column: str, line: float, message: str) -> Column:
        before, after = message.split("%.2f")
        return F.when(
            F.col(column) >= line, F.concat(F.lit(before), fixed_text(F.col(column), 2), F.lit(after))
        )

    found = F.array_compact(
        F.array(
            strong("_b", 0.60, "Low sentence-length burstiness (%.2f) — uniform structure typical of LLMs"),
            strong("_p", 0.60, "Low lexical entropy (%.2f) — predictable word choices typical of AI"),
            strong("_v", 0.60, "Low vocabulary richness (%.2f) — limited lexical diversity"),
            strong("_r", 0.50, "High bigram repetition (%.2f) — repeated phrase patterns"),
            strong("_f", 0.50, "High formal/AI discourse marker density (%.2f)"),
        )
    )
    weak = F.when(F.col("_ai"), F.lit("Multiple weak AI-authorship signals detected")).otherwise(
        F.lit("No strong AI-authorship signals detected")
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(weak))


def entropy_by_group(df: DataFrame) -> DataFrame:
    """Entropy per email by grouping words: email_id, words, entropy.

    Same figures as the in-row form; of use when the words are already a table. Words are
    counted per email before the shuffle.
    """
    tokens = df.select(
        "email_id",
        F.explode_outer(words(full_text(F.col("subject"), F.col("text")))).alias("word"),
    ).filter(F.col("word").isNotNull())
    counts = tokens.groupBy("email_id", "word").agg(F.count(F.lit(1)).alias("c"))
    # H = log2(n) - sum(c log2 c) / n
    return counts.groupBy("email_id").agg(
        F.sum("c").alias("words"),
        (F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("entropy"),
    )
