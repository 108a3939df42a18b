"""Reading of tables and the word rule that several operators share."""

from __future__ import annotations

import pickle

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of characters other than space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"
IN_WORD = r"[^\x20\x09-\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words in order; a NULL text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def shipped(spark: SparkSession, value):
    """Function that gives the value in any task; it goes to each executor once.

    The value's class goes with it, so executors need no copy of the package.
    """
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get():
        if not hasattr(shared, "held"):
            shared.held = pickle.loads(shared.value)
        return shared.held

    return get


BLOCK = 1000


def running_sums(lengths: Column) -> Column:
    """0, first, first + second, ... of a short array."""
    return F.aggregate(lengths, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def without_lines(docs: DataFrame, removed: DataFrame, doc_id: str, text: str, digest: Column | None = None) -> DataFrame:
    """The rows of docs less some lines: all columns, text cut, with _lines and _gone added.

    removed has id, digest (the text's xxhash64 unless given otherwise) and gone: an array
    of structs that begin with line_no, in order. _lines holds the lines of the full text.
    """
    row, no = "_cut_row", "line_no"
    packed = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias(row), docs[doc_id].alias("_cut_id"),
        (F.xxhash64(F.coalesce(docs[text], F.lit(""))) if digest is None else digest).alias("_cut_digest"),
    )
    same = F.col("_cut_id").eqNullSafe(F.col("id")) & (F.col("_cut_digest") == F.col("digest"))
    df = packed.join(removed.select("id", "digest", "gone"), same, "left")
    df = df.select(row, "gone", F.when(F.col("gone").isNotNull(), lines_of(F.col(f"{row}.{text}"))).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.transform("gone", lambda x: x[no]))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n")
    full = F.col(f"{row}.{text}")
    columns = [F.col(f"{row}.{c}").alias(c) if c != text else F.when(F.col("gone").isNull(), full).otherwise(kept).alias(c) for c in docs.columns]
    return df.select(*columns, F.col("lines").alias("_lines"), F.col("gone").alias("_gone"))
