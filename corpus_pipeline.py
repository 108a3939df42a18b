"""A corpus for training: rules, line copies, near copies, mixing, pieces.

Each stage takes the documents its predecessor kept and returns documents with the same
columns; the last one adds the piece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsieve.llm import line_dedup, minhash, mixing, quality_rules, sentencepiece
from mailsieve.llm.common import read_table
from mailsieve.llm.queries import PIECE_MODEL
from mailsieve.session import written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the production policy."""
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that resemble an earlier one; n_chars follows."""
    cut = line_dedup.dedup(docs).drop("n_removed")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near copies."""
    return minhash.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeat(docs, mixing.letter_share(docs["text"]))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document; text is what they decode to."""
    table = sentencepiece.load(PIECE_MODEL)
    rows = sentencepiece.encode(docs, table, decoded="text")
    return rows.withColumn("n_pieces", F.size("piece_ids")).select(*docs.columns, "piece_ids", "n_pieces")


STAGES = [
    ("quality_rules", rules),
    ("line_dedup", lines),
    ("near_dedup", near_copies),
    ("source_mix", mix),
    ("sentencepiece", pieces),
]

# Samples, line matches and piece ids are beyond SQL; the tests hold them against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
