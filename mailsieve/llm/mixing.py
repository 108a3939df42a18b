"""Mixing sources to target shares by weighted sampling without replacement.

Every document draws an exponential key divided by its quality weight, so the smallest
keys of a source are a weighted sample of any length. A source first passes whole as often
as its target allows (complete epochs); the rest of the budget is filled in key order.
Prefix sums run over key buckets and then inside each bucket, so a source that holds most
of the rows is spread over many tasks. Buckets are steps of the key's logarithm: whatever
the weights, an exponential key falls into a step of width s with a probability of s/e at
most, so the step that keeps BUCKET_ROWS rows to a bucket follows from the source's rows
alone. Only ids, sizes and keys move.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsieve.llm.common import words_of
from mailsieve.session import small_side, written

MAX_EPOCHS = 3
BUCKET_ROWS = 2_000


def letter_share(text: Column) -> Column:
    """Quality weight of the registered mix: letters among all characters, .05 at least."""
    n = F.length(F.coalesce(text, F.lit("")))
    letters = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}]+", ""))
    return F.greatest(F.lit(0.05), letters / F.greatest(n, F.lit(1)))


def key_of(doc_id: Column, weight: Column, seed: int, text: Column, source: Column) -> Column:
    """Exponential key: -ln(u) / weight with u in (0, 1] from the id's digest, or that of
    source and text where the id is NULL."""
    row = F.concat(F.lit("row:"), F.coalesce(source.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    digits = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), row)))
    u = (F.conv(F.substring(digits, 1, 13), 16, 10).cast("double") + 1) / float(16**13)
    return -F.log(u) / weight


def targets(sources: DataFrame) -> DataFrame:
    """Adds target to (source, source_size, ...).

    Sources in code point order, NULL last, weigh 1, 2, 3 and so on again; they share the
    sum of all sizes. A target stops at MAX_EPOCHS times its source's size and the excess
    goes to the others by weight: in order of size over weight, the capped ones come
    first. One row per source is all this window sees.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    df = sources.withColumn("w", ((rank - 1) % 3 + 1).cast("double"))
    df = df.withColumn("cap", (MAX_EPOCHS * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))
    df = df.withColumn("level", left / F.sum("w").over(onward))
    df = df.withColumn("open", F.col("cap") > F.col("level") * F.col("w"))
    df = df.withColumn("water", F.max(F.when(F.col("open"), F.col("level"))).over(everything))
    target = F.when(F.col("open"), F.col("water") * F.col("w")).otherwise(F.col("cap"))
    return df.withColumn("target", target).drop("w", "cap", "level", "open", "water")


def mix(
    docs: DataFrame,
    weight: Column | None = None,
    seed: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken; one row per row of docs.

    size counts words (NULL text: 0), copies says how often the mix takes the document and
    taken is copies times size. Ties of key go by id and size; rows that are equal in all
    of these may be swapped without effect. An empty table gives no rows.
    """
    weight = F.lit(1.0) if weight is None else weight
    sized = docs.select(
        docs[doc_id].alias("doc_id"),
        F.size(words_of(docs[text])).cast("long").alias("size"),
        docs[source].alias("source"),
        key_of(docs[doc_id], weight, seed, docs[text], docs[source]).alias("key"),
    )
    sized = written(sized, "mix-sizes").withColumn("part", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    sources = sized.groupBy("part").agg(
        F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")
    )
    sources = written(targets(sources), "mix-targets")
    size = F.greatest(F.col("source_size"), F.lit(1))
    full = F.least(F.floor(F.col("target") / size), F.lit(MAX_EPOCHS)).cast("long")
    sources = sources.withColumn("full", full).withColumn("rest", F.col("target") - full * F.col("source_size"))
    sources = sources.withColumn("steps", F.col("n") / F.lit(math.e * BUCKET_ROWS))
    rows = sized.join(small_side(sources.drop("source")), "part")
    rows = rows.withColumn("bucket", F.floor(F.log(F.greatest("key", F.lit(1e-300))) * F.col("steps")))
    sums = rows.groupBy("part", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(sums, ["part", "bucket"])
    before = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    # A document belongs to the rest if at least half of it lies within the budget.
    extra = F.when(2 * before + F.col("size") <= 2 * F.col("rest"), 1).otherwise(0)
    rows = rows.withColumn("copies", F.least(F.col("full") + extra, F.lit(MAX_EPOCHS)).cast("long"))
    return rows.select(
        "doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def repeat(
    docs: DataFrame,
    weight: Column | None = None,
    seed: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The rows of docs as often as mix() takes them, all columns unchanged.

    Rows equal in id, source and size are taken as often in all as mix() takes them
    together: the copies that are over go to the first of them by partition and place.
    """
    taken = mix(docs.withColumn("_mix_weight", F.lit(1.0) if weight is None else weight), F.col("_mix_weight"), seed, doc_id, text, source)
    taken = taken.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("m"))
    taken = written(taken.filter("copies > 0").toDF("m_id", "m_source", "m_size", "copies", "m"), "mix-copies")
    packed = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("_mix_row"), docs[doc_id].alias("_mix_id"),
        docs[source].alias("_mix_source"), F.size(words_of(docs[text])).cast("long").alias("_mix_size"),
    )
    same = F.col("_mix_id").eqNullSafe(F.col("m_id")) & F.col("_mix_source").eqNullSafe(F.col("m_source")) & (F.col("_mix_size") == F.col("m_size"))
    # One key of a source at most is cut by its budget; only its equal rows differ.
    cut = taken.filter("copies % m <> 0")
    extra = F.lit(0)
    if cut.limit(1).count():
        packed = written(packed.withColumn("_mix_no", F.monotonically_increasing_id()), "mix-rows")
        packed = packed.join(small_side(_first_rows(packed, cut, same)), ["_mix_no"], "left")
        extra = F.coalesce(F.col("_mix_extra"), F.lit(0))
    times = (F.floor(F.col("copies") / F.col("m")) + extra).cast("int")
    rows = packed.join(taken, same).withColumn("times", times).filter("times > 0")
    return rows.select("_mix_row", F.explode(F.sequence(F.lit(1), "times")).alias("n")).select("_mix_row.*")


def _first_rows(packed: DataFrame, cut: DataFrame, same: Column) -> DataFrame:
    """_mix_no and _mix_extra (1) of the first copies % m rows of each key that is cut.

    Rows are numbered inside their partition, and partitions by the rows before them, so
    equal rows are spread over as many tasks as they came from.
    """
    key = ["m_id", "m_source", "m_size"]
    part = F.shiftright("_mix_no", 33).alias("part")
    rows = packed.select("_mix_id", "_mix_source", "_mix_size", "_mix_no", part).join(small_side(cut), same)
    rows = rows.select("_mix_no", "part", F.md5(F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in key])).alias("key"), (F.col("copies") % F.col("m")).alias("over"))
    sums = rows.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("key", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("key", "part").orderBy("_mix_no"))
    placed = rows.withColumn("place", place).join(sums, ["key", "part"])
    return placed.filter(F.col("before") + F.col("place") <= F.col("over")).select("_mix_no", F.lit(1).alias("_mix_extra"))
