"""Aggregator: layer scores to one verdict with redistributed weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.functions.columns import fixed_text, round4
from mailsieve.rules import verdicts as R

# Score column per layer; NULL means the layer did not run.
RISK_COLUMNS = {layer: f"{layer}_risk" for layer in R.LAYER_WEIGHTS}


def text_risk() -> Column:
    """Confidence of a phishing verdict, its complement otherwise."""
    return F.when(F.col("is_phishing"), F.col("confidence")).otherwise(
        F.lit(1.0) - F.col("confidence")
    )


def weighted_risk(active: Sequence[str] | None = None) -> Column:
    """Weighted mean of the layers that ran; the weights of the others are shared out."""
    layers = [x for x in R.LAYER_WEIGHTS if active is None or x in active]
    total = F.lit(0.0)
    for layer in layers:
        ran = F.col(RISK_COLUMNS[layer]).isNotNull()
        total = total + F.when(ran, F.lit(R.LAYER_WEIGHTS[layer])).otherwise(F.lit(0.0))
    mean = F.lit(0.0)
    for layer in layers:
        risk = F.col(RISK_COLUMNS[layer])
        share = F.lit(R.LAYER_WEIGHTS[layer]) / total
        mean = mean + F.when(risk.isNotNull(), risk * share).otherwise(F.lit(0.0))
    return mean


def flagging_layers(active: Sequence[str] | None = None) -> Column:
    """Number of layers above their flagging line."""
    count = F.col("is_phishing").cast("int")
    for layer, line in R.LAYER_FLAG_AT.items():
        if active is None or layer in active:
            count = count + F.coalesce(
                (F.col(RISK_COLUMNS[layer]) >= line).cast("int"), F.lit(0)
            )
    return count


def verdict_of(risk: Column) -> Column:
    return (
        F.when(risk >= R.PHISHING_AT, "PHISHING")
        .when(risk >= R.SUSPICIOUS_AT, "SUSPICIOUS")
        .otherwise("SAFE")
    )


def aggregate_risk(
    df: DataFrame, active: Sequence[str] | None = None, ai_signal: bool = True, boost: bool = True
) -> DataFrame:
    """Add weighted_risk, flagging_layers, combined_risk, overall_risk_score and
    overall_verdict.

    Needs is_phishing, confidence, is_ai_generated and one <layer>_risk column per layer.
    active, ai_signal and boost leave parts out, for ablation. Narrow.
    """
    one = F.lit(1.0)
    base = df.withColumn("text_risk", text_risk())
    base = base.withColumns(
        {"weighted_risk": weighted_risk(active), "flagging_layers": flagging_layers(active)}
    )
    risk = F.col("weighted_risk")
    if ai_signal:
        ai = F.coalesce("is_ai_generated", F.lit(False)) & F.col("is_phishing")
        risk = F.when(ai, F.least(one, risk + F.lit(R.AI_PHISHING_BOOST))).otherwise(risk)
    if boost:
        flagged = F.col("flagging_layers")
        risk = (
            F.when(flagged >= 3, F.least(one, risk + F.lit(R.THREE_LAYERS_BOOST)))
            .when(flagged >= 2, F.least(one, risk + F.lit(R.TWO_LAYERS_BOOST)))
            .otherwise(risk)
        )
    base = base.withColumn("combined_risk", risk)
    return base.withColumns(
        {
            "overall_risk_score": round4(F.col("combined_risk")),
            "overall_verdict": verdict_of(F.col("combined_risk")),
        }
    )


def two_layer_risk(df: DataFrame) -> DataFrame:
    """Add overall_risk_score and overall_verdict from text and URLs alone.

    Needs is_phishing, confidence and url_risk (NULL counts as 0). Narrow.
    """
    risk = text_risk() * R.TEXT_SHARE + F.coalesce("url_risk", F.lit(0.0)) * R.URL_SHARE
    base = df.withColumn("combined_risk", risk)
    combined = F.col("combined_risk")
    return base.withColumns(
        {
            "overall_risk_score": round4(combined),
            "overall_verdict": F.when(combined >= R.TWO_LAYER_PHISHING_AT, "PHISHING")
            .when(combined >= R.TWO_LAYER_SUSPICIOUS_AT, "SUSPICIOUS")
            .otherwise("SAFE"),
        }
    )


def phishing_factor() -> Column:
    return F.concat(
        F.lit("Email text classified as phishing ("),
        fixed_text(F.col("confidence") * 100, 1),
        F.lit("% confidence)"),
    )


def ai_factor() -> Column:
    percent = F.bround(F.col("ai_authorship_score") * 100, 0).cast("int").cast("string")
    return F.concat(F.lit("Email text likely AI-generated (score: "), percent, F.lit("%)"))


# Steps added one after the other: name, layers, authorship signal, agreement boost.
ABLATION_STEPS = [
    ("text", ["text"], False, False),
    ("+ url", ["text", "url"], False, False),
    ("+ headers", ["text", "url", "headers"], False, False),
    ("+ links", ["text", "url", "headers", "links"], False, False),
    ("+ authorship", ["text", "url", "headers", "links"], True, False),
    ("all + boost", list(R.LAYER_WEIGHTS), True, True),
]


def ablate_layers(df: DataFrame, label: str = "label", steps=None) -> DataFrame:
    """Accuracy and false-negative rate as layers are added: step, name, emails, ...

    A verdict other than SAFE counts as caught. All steps are evaluated on each row in one
    pass, so the only shuffle carries one partial row per task.
    """
    steps = steps or ABLATION_STEPS
    base = df
    parts = []
    for number, (name, layers, ai_signal, boost) in enumerate(steps):
        scored = aggregate_risk(base, layers, ai_signal, boost)
        caught = f"_caught_{number}"
        base = scored.withColumn(caught, F.col("overall_verdict") != "SAFE").drop(
            "weighted_risk", "flagging_layers", "combined_risk", "overall_risk_score",
            "overall_verdict",
        )
        truth = F.col(label) == 1
        right = F.count_if(F.col(caught) == truth)
        missed = F.count_if(truth & ~F.col(caught))
        parts.append(
            F.struct(
                F.lit(number).alias("step"),
                F.lit(name).alias("layers"),
                F.count(F.lit(1)).alias("emails"),
                F.try_divide(right, F.count(F.lit(1))).alias("accuracy"),
                F.try_divide(missed, F.count_if(truth)).alias("false_negative_rate"),
            )
        )
    return base.agg(F.array(*parts).alias("steps")).select(F.inline("steps"))


def composition(df: DataFrame) -> DataFrame:
    """Rows per group: legitimate, human-written phishing, machine-written phishing."""
    group = (
        F.when(F.col("label") == 0, "legitimate")
        .when(F.col("source") == "llm", "llm_phishing")
        .otherwise("human_phishing")
    )
    return df.groupBy(group.alias("kind")).agg(F.count(F.lit(1)).alias("emails"))
