"""Text classification: pluggable scorers and the columns derived from their score."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.functions.text import NOT_SPACE, clean_inference, combine_subject_body, full_text
from mailsieve.operators.explain import family_bits, with_risk_categories
from mailsieve.rules import verdicts as R
from mailsieve.session import small_side, written


class Scorer(Protocol):
    """Adds the phishing probability of each row as a column."""

    def score(
        self, df: DataFrame, text: str = "text", subject: str | None = "subject",
        out: str = "p_phishing",
    ) -> DataFrame: ...


def _subject(subject: str | None) -> Column:
    return F.lit("") if subject is None else F.col(subject)


class RuleScorer:
    """p = .10 + .15 per risk family found, at most 1. Narrow."""

    def score(
        self, df: DataFrame, text: str = "text", subject: str | None = "subject",
        out: str = "p_phishing",
    ) -> DataFrame:
        whole = full_text(_subject(subject), F.col(text))
        found = with_risk_categories(df, whole, "_families")
        return found.withColumn(out, self.of_families(F.size("_families"))).drop("_families")

    def of_families(self, found: Column) -> Column:
        """The probability from the number of families found."""
        return F.least(F.lit(100), F.lit(10) + found * 15) / F.lit(100.0)

    def families(self, text: Column, subject: Column) -> Column:
        """Families of a text as bits; a line break parts a text into texts of their own."""
        return family_bits(full_text(subject, text))


def model_tokens(text: Column, subject: Column, max_tokens: int | None = None) -> Column:
    """Blank-separated tokens of the cleaned text; all of them unless capped."""
    combined = combine_subject_body(F.coalesce(subject, F.lit("")), F.coalesce(text, F.lit("")))
    tokens = F.regexp_extract_all(clean_inference(combined), F.lit(f"{NOT_SPACE}+"), F.lit(0))
    return tokens if max_tokens is None else F.slice(tokens, 1, max_tokens)


def fit_text_model(
    train: DataFrame, features: int = 1 << 16, max_iter: int = 20, max_tokens: int | None = None
) -> PipelineModel:
    """Fit hashed term weights and logistic regression on (text, label) rows.

    The hashed terms are written once: fitting reads them again and again, and the cleaning
    of the texts costs more than all of it.
    """
    subject = F.col("subject") if "subject" in train.columns else F.lit("")
    rows = train.select(
        model_tokens(F.col("text"), subject, max_tokens).alias("_tokens"),
        F.col("label").cast("double").alias("label"),
        *([F.col("weight")] if "weight" in train.columns else []),
    )
    regression = LogisticRegression(
        featuresCol="_features", maxIter=max_iter, regParam=0.01, probabilityCol="_probability",
        rawPredictionCol="_raw", predictionCol="_prediction",
        **({"weightCol": "weight"} if "weight" in train.columns else {}),
    )
    hashing = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features)
    hashed = written(hashing.transform(rows).drop("_tokens"), "hashed-terms")
    idf = IDF(inputCol="_tf", outputCol="_features").fit(hashed)
    return PipelineModel([hashing, idf, regression.fit(idf.transform(hashed))])


class ModelScorer:
    """Scores with a fitted Spark ML pipeline."""

    def __init__(self, model: PipelineModel, max_tokens: int | None = None):
        self.model = model
        self.max_tokens = max_tokens

    def score(
        self, df: DataFrame, text: str = "text", subject: str | None = "subject",
        out: str = "p_phishing",
    ) -> DataFrame:
        rows = df.withColumn(
            "_tokens", model_tokens(F.col(text), _subject(subject), self.max_tokens)
        )
        scored = self.model.transform(rows)
        return scored.withColumn(out, F.get(vector_to_array("_probability"), F.lit(1))).drop(
            "_tokens", "_tf", "_features", "_raw", "_probability", "_prediction"
        )


class BatchScorer:
    """Scores with any model that maps a batch of cleaned texts to probabilities.

    load runs once per task and returns the function to call for each Arrow batch.
    """

    def __init__(self, load: Callable[[], Callable[[pd.Series], pd.Series]]):
        self.load = load

    def score(
        self, df: DataFrame, text: str = "text", subject: str | None = "subject",
        out: str = "p_phishing",
    ) -> DataFrame:
        load = self.load

        @F.pandas_udf("double")
        def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for batch in batches:
                yield model(batch)

        combined = combine_subject_body(F.coalesce(_subject(subject), F.lit("")), F.col(text))
        return df.withColumn(out, predict(clean_inference(combined)))


def portable(model: PipelineModel) -> Callable[[], Callable[[pd.Series], pd.Series]]:
    """A fitted text model as a BatchScorer load function, without Spark in the tasks.

    One weight per hashed term (frequency scale times coefficient) is all it holds, so its
    size is that of the model whatever the texts are. A task hashes a word it knows once.
    """
    hashing, idf, regression = model.stages
    weights = idf.idf.toArray() * regression.coefficients.toArray()
    intercept, size = float(regression.intercept), hashing.getNumFeatures()

    def load() -> Callable[[pd.Series], pd.Series]:
        known: dict[str, float] = {}

        def place(term: str) -> int:
            """MurmurHash3 (32 bits, seed 42) as HashingTF numbers terms by it."""
            data, h, low = term.encode(), 42, 0xFFFFFFFF
            whole = len(data) // 4 * 4
            for i in range(0, len(data), 4):
                k = (int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51) & low
                h ^= (((k << 15) | (k >> 17)) * 0x1B873593) & low
                if i < whole:
                    h = (((h << 13) | (h >> 19)) * 5 + 0xE6546B64) & low
            h ^= len(data)
            h = ((h ^ (h >> 16)) * 0x85EBCA6B) & low
            h = ((h ^ (h >> 13)) * 0xC2B2AE35) & low
            h ^= h >> 16
            return (h - (1 << 32) if h >> 31 else h) % size

        def weight(term: str) -> float:
            if term not in known:
                if len(known) > 1_000_000:
                    known.clear()
                known[term] = float(weights[place(term)])
            return known[term]

        def predict(texts: pd.Series) -> pd.Series:
            sums = [intercept + sum(weight(t) for t in text.split(" ") if t) for text in texts]
            return pd.Series([1 / (1 + math.exp(-x)) if x > -700 else 0.0 for x in sums], dtype="float64")

        return predict

    return load


@dataclass(frozen=True)
class TermModel:
    """Weights of evidence per term and the prior, in millionths of a logit.

    weights: term, with_1 and with_0 (training rows of either label that hold it), weight.
    Whole numbers make sums the same in whatever order they are taken.
    """

    weights: DataFrame
    prior: int


MILLIONTHS = 1_000_000


def _logit(ones: Column, all_ones: int, zeros: Column, all_zeros: int) -> Column:
    """ln of the smoothed shares' ratio in millionths."""
    ratio = F.log((ones + 1) / F.lit(all_ones + 2.0)) - F.log((zeros + 1) / F.lit(all_zeros + 2.0))
    return F.floor(ratio * F.lit(float(MILLIONTHS)) + F.lit(0.5)).cast("long")


def fit_term_model(train: DataFrame, min_rows: int = 2, max_tokens: int | None = None) -> TermModel:
    """Naive Bayes on the presence of terms, fitted by one aggregation over (text, label) rows.

    Terms in fewer than min_rows rows have no weight. Rows with a NULL label are left out;
    counts combine before the shuffle, so a frequent term is no large group.
    """
    subject = F.col("subject") if "subject" in train.columns else F.lit("")
    rows = train.filter(F.col("label").isin(0, 1))
    ones, zeros = rows.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    tokens = F.array_distinct(model_tokens(F.col("text"), subject, max_tokens))
    counts = (
        rows.select("label", F.explode(tokens).alias("term"))
        .groupBy("term")
        .agg(F.count_if(F.col("label") == 1).alias("with_1"), F.count_if(F.col("label") == 0).alias("with_0"))
        .filter(F.col("with_1") + F.col("with_0") >= min_rows)
    )
    weights = counts.withColumn("weight", _logit(F.col("with_1"), ones, F.col("with_0"), zeros))
    prior = math.floor(math.log((ones + 1) / (zeros + 1)) * MILLIONTHS + 0.5)
    return TermModel(written(weights, "term-weights"), prior)


class TermScorer:
    """Scores with the weights of a TermModel; rows are told apart by a key column.

    A row's logit is the prior plus the weights of its distinct terms. The weights go to
    every task where they are small, and then a row's terms are summed where they are;
    otherwise terms and weights meet by a join whose busy terms are split at run time. Only
    keys and terms are shuffled for the sums. A NULL or repeated key gets the prior or the
    sum over its rows' distinct terms.
    """

    def __init__(self, model: TermModel, key: str = "email_id", max_tokens: int | None = None):
        self.model, self.key, self.max_tokens = model, key, max_tokens

    def logits(self, df: DataFrame, text: str = "text", subject: str | None = "subject") -> DataFrame:
        """Key and logit (millionths) of the rows that hold a weighted term."""
        tokens = model_tokens(F.col(text), _subject(subject), self.max_tokens)
        terms = df.select(F.col(self.key).alias("_key"), F.explode(F.array_distinct(tokens)).alias("term"))
        held = terms.join(small_side(self.model.weights.select("term", "weight")), "term")
        return held.groupBy("_key").agg((F.sum("weight") + self.model.prior).alias("_logit"))

    def score(
        self, df: DataFrame, text: str = "text", subject: str | None = "subject",
        out: str = "p_phishing",
    ) -> DataFrame:
        known = df.join(self.logits(df, text, subject), F.col(self.key) == F.col("_key"), "left")
        logit = F.coalesce("_logit", F.lit(self.model.prior)) / F.lit(float(MILLIONTHS))
        # Beyond 30 the probability is 0 or 1 in the digits that count.
        logit = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))
        return known.withColumn(out, 1 / (1 + F.exp(-logit))).drop("_key", "_logit")


def classify(df: DataFrame, p: str = "p_phishing") -> DataFrame:
    """Add is_phishing, confidence, label and risk_level from a phishing probability."""
    score = F.col(p)
    phishing = score > 0.5
    return with_risk_level(
        df.withColumns(
            {
                "is_phishing": phishing,
                "confidence": F.when(phishing, score).otherwise(F.lit(1.0) - score),
            }
        )
    )


def with_risk_level(df: DataFrame) -> DataFrame:
    """Add label and risk_level from is_phishing and confidence."""
    phishing, confidence = F.col("is_phishing"), F.col("confidence")
    return df.withColumns(
        {
            "label": F.when(phishing, "PHISHING").otherwise("LEGITIMATE"),
            "risk_level": F.when(phishing & (confidence >= R.HIGH_RISK_AT), "HIGH")
            .when(phishing & (confidence >= R.MEDIUM_RISK_AT), "MEDIUM")
            .otherwise("LOW"),
        }
    )


def classify_four(df: DataFrame, probabilities: str = "probabilities") -> DataFrame:
    """As classify, from the four class probabilities; classes 1 and 3 are phishing."""
    p = F.col(probabilities)
    best = F.array_position(p, F.array_max(p)).cast("int") - 1
    names = F.array(*[F.lit(n) for n in R.CLASS_NAMES])
    return with_risk_level(
        df.withColumns(
            {
                "predicted_class": F.get(names, best),
                "is_phishing": best.isin(R.PHISHING_CLASSES),
                "confidence": F.array_max(p),
            }
        )
    )


def batch_summary(df: DataFrame) -> DataFrame:
    """Total, phishing and legitimate counts of a classified batch."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_phishing").alias("phishing_count"),
        F.count_if(~F.col("is_phishing")).alias("legitimate_count"),
    )
