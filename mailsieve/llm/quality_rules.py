"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit
per failed rule; a policy is a named, versioned set of rules, so applying another policy
or asking what one rule alone removes is bit arithmetic on the ledger and never reads a
text again. All of it is built-in column expressions without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.common import IN_WORD, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 3

MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_letters", "n_capitals",
]


def _over(part: str, limit: float, whole: str) -> Column:
    return F.col(part) > F.lit(limit) * F.col(whole)


# Bit positions never change; a rule that changes gets a new name at the end.


def rules() -> dict[str, Column]:
    """Failing conditions over the measurements; the position in the list is the bit."""
    return {
        "few_words": F.col("n_words") < 50,
        "repeated_words": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "short_words": F.col("word_chars") < 3 * F.col("n_words"),
        "long_words": F.col("word_chars") > 15 * F.col("n_words"),
        "symbols": _over("n_symbols", 0.1, "n_words"),
        "repeated_lines": _over("n_dup_lines", 0.3, "n_lines"),
        "few_letters": F.col("n_letters") < 0.7 * F.col("word_chars"),
        "shouting": _over("n_capitals", 0.4, "n_letters"),
    }


@dataclass(frozen=True)
class Policy:
    """A versioned set of rules; documents that fail any of them are rejected."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = list(rules())
        return sum(1 << names.index(rule) for rule in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
PRODUCTION = Policy(
    "production",
    1,
    (*BASE.rules, "short_words", "long_words", "symbols", "repeated_lines", "few_letters", "shouting"),
)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of docs but the text, and the measurements (all long).

    A NULL or empty text has no words and measures 0 throughout. Columns that bear the
    name of a measurement are replaced. Repeated rows are measured one by one.
    """
    work = "_rules_"
    keep = [docs[c] for c in docs.columns if c != text and c not in MEASURES]
    content = F.coalesce(docs[text], F.lit(""))
    lines = F.filter(F.split(content, "\n"), lambda x: F.rlike(x, F.lit(IN_WORD)))
    df = docs.select(*keep, words_of(docs[text]).alias(work + "words"), lines.alias(work + "lines"))

    def put(df: DataFrame, **new: Column) -> DataFrame:
        return df.withColumns({work + k: v for k, v in new.items()})

    def c(name: str) -> Column:
        return F.col(work + name)

    df = put(
        df,
        n=F.size(c("words")).cast("long"),
        joined=F.array_join(c("words"), ""),
        h=F.transform(c("words"), lambda w: F.xxhash64(w)),
        n_lines=F.size(c("lines")).cast("long"),
        dup_lines=(F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long"),
    ).drop(work + "words", work + "lines")
    # A 64-bit hash stands for each window of words.
    first = F.slice(c("h"), 1, F.greatest(c("n") - (WINDOW - 1), F.lit(0)).cast("int"))
    df = put(
        df, g=F.transform(first, lambda x, i: F.xxhash64(x, *[F.get(c("h"), i + k) for k in range(1, WINDOW)]))
    ).drop(work + "h")
    # Sorted by hash with the position in the low bits, equal windows become neighbours;
    # only texts that repeat a window at all are sorted.
    df = put(df, m=F.when(F.size(F.array_distinct(c("g"))) < F.size(c("g")), F.pow(F.lit(2.0), F.length(F.bin(c("n")))).cast("long")))
    packed = F.transform(c("g"), lambda x, i: x.bitwiseAND(-c("m")).bitwiseOR(i.cast("long")))
    df = put(df, s=F.when(c("m").isNotNull(), F.sort_array(packed)))

    def window(x: Column) -> Column:
        return F.get(c("g"), x.bitwiseAND(c("m") - 1).cast("int"))

    def same(x: Column, k: Column) -> Column:
        return F.coalesce(window(x) == window(F.get(c("s"), k)), F.lit(False))

    repeated = F.filter(c("s"), lambda x, k: same(x, k - 1) | same(x, k + 1))
    df = put(df, p=F.sort_array(F.transform(repeated, lambda x: x.bitwiseAND(c("m") - 1))))
    # Each window covers its words up to the next repeated window's start.
    steps = F.transform(
        c("p"), lambda x, k: F.least(F.lit(WINDOW).cast("long"), F.coalesce(F.get(c("p"), k + 1) - x, F.lit(WINDOW).cast("long")))
    )
    found = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    count = lambda column: F.length(column).cast("long")
    df = df.withColumns(
        {
            "n_words": c("n"),
            "word_chars": count(c("joined")),
            "n_symbols": count(c("joined")) - count(F.translate(c("joined"), SYMBOLS, "")),
            "n_dup_lines": c("dup_lines"),
            "n_repeat_words": F.coalesce(found, F.lit(0).cast("long")),
            "n_lines": c("n_lines"),
            "n_letters": count(F.regexp_replace(c("joined"), r"[^\p{L}]+", "")),
            "n_capitals": count(F.regexp_replace(c("joined"), r"[^\p{Lu}]+", "")),
        }
    )
    # A generated column keeps the optimizer from moving a filter on a measurement in here,
    # where it would repeat each step for every use.
    others = [F.col(x.name) for x in df.schema if not x.name.startswith(work) and x.name not in MEASURES]
    found = F.explode(F.array(F.struct(*MEASURES))).alias(work + "found")
    return df.select(*others, found).select(*others, work + "found.*")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Measurements and fail_bits (long): bit i is set if rule i fails."""
    df = measure(docs, text)
    bits = F.lit(0).cast("long")
    for i, failed in enumerate(rules().values()):
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << i)).otherwise(0).cast("long"))
    return df.withColumn("fail_bits", bits)


def failed(policy: Policy) -> Column:
    """Whether a ledger row fails the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) != 0


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone, and that the
    policy keeps without it. One count per bit pattern is all that is shuffled.
    """
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).count()
    names = list(rules())
    bit_of = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in policy.rules]))
    per_rule = patterns.withColumn("r", bit_of).select("bits", "count", "r.rule", "r.bit")
    total = lambda condition: F.sum(F.when(condition, F.col("count")).otherwise(0))
    return per_rule.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(F.col("bits") == F.col("bit")).alias("n_failed_alone"),
        total(F.col("bits").bitwiseAND(F.lit(policy.mask)).bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
    )


def keep(docs: DataFrame, policy: Policy = PRODUCTION, text: str = "text") -> DataFrame:
    """The rows of docs that pass the policy, all columns unchanged."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text].alias("content"))
    return ledger(packed, "content").filter(~failed(policy)).select("row.*")
