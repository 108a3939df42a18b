"""Curated corpus from raw corpora: load, union, clean, drop copies, sample, split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsieve.operators.curation import (
    clean_long,
    dedup_exact,
    quota_table,
    sample_quota,
    stratified_split,
    union_sources,
)
from mailsieve.session import written
from mailsieve.sources.corpora import CORPORA, read_corpus

SEED = 42


def with_row_id(df: DataFrame) -> DataFrame:
    """row_id: digest of the row's place in the union and its text, equal for equal rows."""
    return df.withColumn(
        "row_id", F.sha2(F.concat_ws("|", "source_rank", "source", "label", "text"), 256)
    )


def build_corpus(
    spark: SparkSession, paths: dict[str, str], quotas: DataFrame | None = None, seed: int = SEED
) -> DataFrame:
    """Corpus with text, label, source, email_type and split from files per corpus kind.

    Cleaning, the length filter and the removal of copies run on all rows; the quota per
    source and label is applied once, on what is left. The first source keeps a text, and
    one of its rows. The cleaned corpus is written to the shared folder with a number per
    row, so copies are found by digests and numbers, and the sampling and splitting passes
    read their key columns only: texts are in no aggregate, sort or broadcast.
    """
    frames = [read_corpus(spark, paths[kind], kind) for kind in CORPORA if kind in paths]
    master = clean_long(union_sources(frames))
    master = written(with_row_id(master).withColumn("row_no", F.monotonically_increasing_id()), "corpus-all")
    master = written(dedup_exact(master, ["source_rank", "row_no"]).drop("row_no"), "corpus")
    if quotas is None:
        quotas = quota_table(spark)
    sampled = sample_quota(master, quotas, seed, "row_id")
    return stratified_split(sampled, seed, "row_id").drop("source_rank", "row_id")
