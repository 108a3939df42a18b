"""Language of a text by words first, then by ever shorter character n-grams.

The model holds log frequencies per language of the words and n-grams of a bounded sample
of labelled documents. A known word scores by its own frequencies; an unseen one by the
longest n-grams of it that are known at all. The model is bounded by its parameters and
is what each task gets; the texts are read whole, in place, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.common import shipped

# A word: letters and the marks on them, with a letter at least; one rule for learning
# (Java) and prediction.
WORD = r"\p{M}*\p{L}[\p{L}\p{M}]*"
WORDS, PLAIN_WORDS = regex.compile(WORD), re.compile("[a-z]+")


def words_in(text: str) -> list[str]:
    """Words of a lower-case text."""
    return (PLAIN_WORDS if text.isascii() else WORDS).findall(text)
UNKNOWN = "und"
EDGE = "\x02"
CACHE = 300_000


@dataclass
class Model:
    """langs, and per n (0: whole words) a map from string to its row of scores."""

    langs: list[str]
    tables: dict[int, dict[str, int]]
    scores: dict[int, np.ndarray]
    cache: dict[str, np.ndarray] = field(default_factory=dict)

    def word(self, word: str) -> np.ndarray:
        """Log score per language of one lower-case word."""
        row = self.tables[0].get(word)
        if row is not None:
            return self.scores[0][row]
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            found = self.cache[word] = self.unseen(word)
        return found

    def unseen(self, word: str) -> np.ndarray:
        padded = EDGE + word + EDGE
        for n in sorted((n for n in self.tables if n), reverse=True):
            table = self.tables[n]
            rows = [r for i in range(len(padded) - n + 1) if (r := table.get(padded[i : i + n])) is not None]
            if rows:
                return self.scores[n][rows].mean(axis=0)
        return np.zeros(len(self.langs))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Best language and its posterior; 'und' and 0 without a letter."""
        words = Counter(words_in((text or "").lower()))
        if not words or not self.langs:
            return UNKNOWN, 0.0
        total = np.array(list(words.values()), dtype=float) @ np.array([self.word(w) for w in words])
        odds = np.exp(total - total.max())
        best = int(odds.argmax())
        return self.langs[best], float(odds[best] / odds.sum())


def held_out(doc_id: Column) -> Column:
    """The fifth of the ids that no model may learn from; a NULL id belongs to no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _table(counts: DataFrame, langs: list[str], most: int) -> tuple[dict[str, int], np.ndarray]:
    """Row numbers and smoothed log frequencies of the most frequent strings."""
    wide = counts.groupBy("gram").agg(
        *[F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"l{i}") for i, lang in enumerate(langs)]
    )
    total = sum((F.col(f"l{i}") for i in range(len(langs))), F.lit(0))
    rows = wide.orderBy(total.desc(), "gram").limit(most).collect()
    n = np.array([[float(x) for x in r[1:]] for r in rows]).reshape(len(rows), len(langs))
    scores = np.log((n + 0.5) / (n.sum(axis=0) + 0.5 * max(1, len(rows))))
    return {r[0]: i for i, r in enumerate(rows)}, scores


def _grams(text: Column, n: int) -> Column:
    """The n-grams of a string in order; none of a shorter one."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1)))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))


def fit(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    doc_id: str = "doc_id",
    docs_per_lang: int = 2000,
    max_words: int = 100_000,
    max_grams: int = 50_000,
    longest: int = 5,
) -> Model:
    """Model from about docs_per_lang documents of each language, chosen by id digest.

    Rows without text or language are left out. max_words and max_grams (per n) bound the
    model; languages come in code point order.
    """
    rows = labelled.select(labelled[doc_id].alias("id"), labelled[text].alias("content"), labelled[lang].alias("lang"))
    rows = rows.filter("content IS NOT NULL AND lang IS NOT NULL")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], {0: {}}, {0: np.zeros((0, 0))})
    u = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(1 << 30)) / float(1 << 30)
    chosen = F.lit(False)
    for name, n in sizes.items():
        chosen = chosen | ((F.col("lang") == name) & (u < docs_per_lang / n))
    words = F.regexp_extract_all(F.lower("content"), F.lit(WORD), F.lit(0))
    counted = rows.filter(chosen).select("lang", F.explode(words).alias("gram")).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n")).cache()
    tables, scores = {}, {}
    tables[0], scores[0] = _table(counted, langs, max_words)
    padded = F.concat(F.lit(EDGE), "gram", F.lit(EDGE))
    for n in range(1, longest + 1):
        grams = counted.select("lang", "n", F.explode(_grams(padded, n)).alias("gram"))
        tables[n], scores[n] = _table(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")), langs, max_grams)
    counted.unpersist()
    return Model(langs, tables, scores)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred and score (0 to 1); one row per row of docs.

    A text that is NULL or has no letter gives 'und' with score 0; so does every text if
    nothing was learned. Only the text is looked at.
    """
    held = shipped(docs.sparkSession, model)
    named = docs.select(*[docs[c] for c in keep], docs[text].alias("_text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held().predict(t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*keep, "lang_pred", "score"],
            )

    schema = named.drop("_text").schema.add("lang_pred", "string").add("score", "double")
    return named.mapInArrow(score, schema)
