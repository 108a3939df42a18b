"""Writing of corpora and verdicts, and the verdict history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsieve.session import small_side


def write_splits(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Master table partitioned by split; a reader of one split prunes the others."""
    writer = df.write.mode("overwrite").partitionBy("split")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)


def to_json_export(df: DataFrame) -> DataFrame:
    """One JSON document per row in column ``json``."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def log_entries(df: DataFrame, preview_chars: int = 120) -> DataFrame:
    """Rows of the verdict log: email_id, at, preview, verdict, risk_score, layers.

    The preview is the subject and the first preview_chars characters of the text.
    """
    subject = F.coalesce("subject", F.lit(""))
    prefix = F.when(subject != "", F.concat(subject, F.lit(" — "))).otherwise("")
    return df.select(
        "email_id",
        F.col("received_at").alias("at"),
        F.concat(prefix, F.substring("text", 1, preview_chars)).alias("preview"),
        F.col("overall_verdict").alias("verdict"),
        F.col("overall_risk_score").alias("risk_score"),
        F.size("analysis_layers").alias("layers"),
    )


def append_log(entries: DataFrame, path: str, batch: int) -> None:
    """Write the entries of a numbered batch; a batch that is tried again takes its own place.

    The entries go to one folder per batch. Its index row (rows, oldest and newest time),
    written last, is what commits it: readers see no batch without one. An empty batch has
    no index row.
    """
    folder = f"{path}/entries/batch={batch}"
    entries.write.mode("overwrite").parquet(folder)
    held = entries.sparkSession.read.schema(entries.schema).parquet(folder)
    index = held.agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("oldest"), F.max("at").alias("newest"))
    index.filter("rows > 0").coalesce(1).write.mode("overwrite").parquet(f"{path}/index/batch={batch}")


def _log_parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    log, index = spark.read.parquet(f"{path}/entries"), spark.read.parquet(f"{path}/index")
    return log, index


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All entries of committed batches, with their batch."""
    log, index = _log_parts(spark, path)
    return log.join(index.select("batch"), "batch", "left_semi")


def latest(spark: SparkSession, path: str, n: int = 10) -> DataFrame:
    """Newest n entries; only batches that may hold one of them are opened.

    Every batch has a row at its oldest time or later, so the n newest entries are no
    older than the n-th newest of those times. Entries without a time come last.
    """
    log, index = _log_parts(spark, path)
    bounds = [r["oldest"] for r in index.select("oldest").filter("oldest IS NOT NULL").orderBy(F.desc("oldest")).limit(n).collect()]
    if len(bounds) == n:
        log = log.filter(F.col("at") >= F.lit(bounds[-1]))
        index = index.filter(F.col("newest") >= F.lit(bounds[-1]))
    near = log.join(small_side(index.select("batch")), "batch", "left_semi")
    return history(near, n)


def history(log: DataFrame, n: int = 10) -> DataFrame:
    """Newest n entries of the log (a top-n per task, then over the tasks)."""
    return log.orderBy(F.desc("at"), F.desc("email_id")).limit(n)
