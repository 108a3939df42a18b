"""Evaluation of predictions against labels; each report is one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_labels(predictions: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Predictions with their label; rows without label are left out."""
    return predictions.join(labels, key, "inner")


def _cells(label: str, pred: str) -> dict[str, Column]:
    truth, guess = F.col(label) == 1, F.col(pred) == 1
    return {
        "tn": F.count_if(~truth & ~guess),
        "fp": F.count_if(~truth & guess),
        "fn": F.count_if(truth & ~guess),
        "tp": F.count_if(truth & guess),
    }


def _or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def metrics(
    df: DataFrame, label: str = "label", pred: str = "pred", by: list[str] | None = None
) -> DataFrame:
    """n, accuracy, precision, recall and F1 of label 1, 0 where undefined."""
    cells = df.groupBy(*(by or [])).agg(*[c.alias(f"_{n}") for n, c in _cells(label, pred).items()])
    tp, fp, fn, tn = (F.col(f"_{n}") for n in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    return cells.select(
        *(by or []),
        n.alias("n"),
        _or_zero(tp + tn, n).alias("accuracy"),
        _or_zero(tp, tp + fp).alias("precision"),
        _or_zero(tp, tp + fn).alias("recall"),
        _or_zero(tp * 2, tp * 2 + fp + fn).alias("f1"),
    )


def confusion(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """One row: tn, fp, fn, tp."""
    return df.agg(*[c.alias(n) for n, c in _cells(label, pred).items()])


def _accuracy(label: str, pred: str) -> list[Column]:
    right = F.count_if(F.col(label) == F.col(pred))
    return [
        F.try_divide(right, F.count(F.lit(1))).alias("accuracy"),
        F.count(F.lit(1)).alias("samples"),
    ]


def accuracy_by_source(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return df.groupBy("source").agg(*_accuracy(label, pred))


def accuracy_by_source_label(
    df: DataFrame, label: str = "label", pred: str = "pred", totals: bool = False
) -> DataFrame:
    """Accuracy per source and label that occurs; totals adds the subtotals (NULL keys)."""
    grouped = df.cube("source", label) if totals else df.groupBy("source", label)
    return grouped.agg(*_accuracy(label, pred))


def authorship_metrics(df: DataFrame) -> DataFrame:
    """Precision and recall of the authorship flag against machine-written sources."""
    marked = df.withColumns(
        {
            "_label": (F.col("source") == "llm").cast("int"),
            "_pred": F.col("is_ai_generated").cast("int"),
        }
    )
    return metrics(marked, "_label", "_pred")
