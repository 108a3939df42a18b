"""Document fingerprints by consistent weighted sampling, in built-in functions alone.

A text's terms are its words, weighing their counts. A weight is cut into pieces of at
most PIECE, which leaves the generalised Jaccard similarity (sum of minima over sum of
maxima) as it is; pieces are dealt to BINS bins by hash, and each bin keeps one consistent
weighted sample of its pieces. With r and c from Gamma(2, 1) and b from U(0, 1), all from
the piece's hash, t = floor(ln w / r + b), and the piece with the smallest
ln c - r (t - b) - r is the sample. Two texts hold the same sample of a bin with the
probability of the bin's similarity, so the share of equal samples estimates theirs; the
pieces make the bins weigh alike, and one evaluation per piece fills all bins. With
PIECE = 1 weights are expanded into occurrences: ln w and t are 0, the weighted step is
idle, and this is one-permutation MinHash over word occurrences.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsieve.llm.common import words_of

BINS, BIN_BITS = 128, 7
PIECE = 1
SAMPLE_BITS = 28
BUCKET_BYTES = 32 << 20
WORK = "_fp_"


def _uniform(x: Column, high: bool) -> Column:
    """(0, 1) from the upper or lower half of a 64-bit hash."""
    half = F.shiftrightunsigned(x, 32) if high else x.bitwiseAND(F.lit(0xFFFFFFFF))
    return (half.cast("double") + 0.5) * (1.0 / (1 << 32))


def _sample(pieces: Column) -> Column:
    """Per piece: bin, rank and sample packed so that a sort brings each bin's sample first."""

    def seeds(x: Column) -> Column:
        k = x["k"]
        return F.struct(
            k.alias("k"), F.log(x["w"].cast("double")).alias("w"), F.xxhash64(k, F.lit(1)).alias("x"),
            F.xxhash64(k, F.lit(2)).alias("y"), F.xxhash64(k, F.lit(3)).alias("z"),
        )

    def variates(x: Column) -> Column:
        return F.struct(
            x["k"].alias("k"), x["w"].alias("w"), (-F.log(_uniform(x["x"], True) * _uniform(x["x"], False))).alias("r"),
            F.log(-F.log(_uniform(x["y"], True) * _uniform(x["y"], False))).alias("c"), _uniform(x["z"], True).alias("b"),
        )

    def taken(x: Column) -> Column:
        return F.struct(x["k"].alias("k"), x["r"].alias("r"), x["c"].alias("c"), x["b"].alias("b"), F.floor(x["w"] / x["r"] + x["b"]).alias("t"))

    def packed(x: Column) -> Column:
        a = x["c"] - x["r"] * (x["t"] - x["b"]) - x["r"]
        rank = F.least(F.greatest(F.floor((a + 128) * (1 << 20)), F.lit(0)), F.lit((1 << 28) - 1))
        sample = F.xxhash64(x["k"], x["t"]).bitwiseAND(F.lit((1 << SAMPLE_BITS) - 1))
        bin_ = F.shiftleft(x["k"].bitwiseAND(F.lit(BINS - 1)), 63 - BIN_BITS)
        return bin_.bitwiseOR(F.shiftleft(rank, SAMPLE_BITS)).bitwiseOR(sample)

    out = pieces
    for step in (seeds, variates, taken, packed):
        out = F.transform(out, step)
    return out


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds an array of long: bin and sample of each bin that has one, in bin order.

    NULL texts and texts without a word give an empty array.
    """
    c = lambda x: F.col(f"{WORK}{x}")
    bin_of = lambda x: F.shiftright(x, 63 - BIN_BITS)
    df = df.withColumn(f"{WORK}h", F.sort_array(F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w))))
    starts = F.filter(
        F.sequence(F.lit(0), F.size(c("h")) - 1), lambda i: (i == 0) | (F.get(c("h"), i) != F.get(c("h"), i - 1))
    )
    df = df.withColumn(f"{WORK}s", F.when(F.size(c("h")) > 0, starts).otherwise(F.expr("CAST(array() AS ARRAY<INT>)")))
    counted = F.transform(
        c("s"), lambda s, j: F.struct(F.get(c("h"), s).alias("k"), (F.coalesce(F.get(c("s"), j + 1), F.size(c("h"))) - s).alias("n"))
    )
    pieces = F.flatten(
        F.transform(
            counted,
            lambda x: F.transform(
                F.sequence(F.lit(0), F.floor((x["n"] - 1) / PIECE).cast("int")),
                lambda p: F.struct(F.xxhash64(x["k"], p).alias("k"), F.least(F.lit(PIECE), x["n"] - PIECE * p).alias("w")),
            ),
        )
    )
    df = df.withColumn(f"{WORK}p", F.sort_array(_sample(pieces)))
    first = F.filter(c("p"), lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(c("p"), i - 1))))
    whole = lambda x: F.shiftleft(bin_of(x), SAMPLE_BITS).bitwiseOR(x.bitwiseAND(F.lit((1 << SAMPLE_BITS) - 1)))
    df = df.withColumn(name, F.transform(first, whole))
    return df.drop(f"{WORK}h", f"{WORK}s", f"{WORK}p")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples among the bins that either fingerprint fills (0 to 1).

    Two empty fingerprints are alike (1)."""
    bins = lambda x: F.transform(x, lambda y: F.shiftright(y, SAMPLE_BITS))
    filled = F.size(F.array_union(bins(a), bins(b)))
    return F.when(filled == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / filled)


def as_text(fingerprint: Column) -> Column:
    """Nine hex digits per filled bin."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 9, "0")), "")


def with_next(docs: DataFrame, doc_id: str, text: str, prepared) -> DataFrame:
    """Rows of docs beside the next one by (doc_id, text digest), after the last the first.

    prepared adds columns to (id, text); the columns of the next row are named next_*. The
    texts move once, to buckets of neighbouring ids; the first row of each bucket is sent
    to the bucket before as well, so no row looks further than its bucket. A NULL id
    comes first. Rows equal in id and text follow each other.
    """
    spark = docs.sparkSession
    own = docs.select(docs[doc_id].cast("long").alias("id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    n_bytes, nulls = own.select(F.sum(F.octet_length("text")), F.count_if(F.col("id").isNull())).first()
    n = int(max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), (n_bytes or 0) // BUCKET_BYTES))
    shares = [i / n for i in range(1, n)]
    bounds = sorted(set(own.select(F.percentile_approx("id", shares, 10 * n)).first()[0] or [])) if n > 1 else []
    marks = F.lit(bounds) if bounds else F.expr("CAST(array() AS ARRAY<BIGINT>)")
    steps = [1 << i for i in reversed(range(max(1, math.ceil(math.log2(len(bounds) + 1)))))]
    bucket = F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, s: F.when(F.coalesce(F.get(marks, at + s - 1) <= F.col("id"), F.lit(False)), at + s).otherwise(at),
    )
    own = own.withColumn("bucket", bucket)
    firsts = {r[0]: r[1] for r in own.groupBy("bucket").agg(F.min("id")).collect()}
    if nulls:
        firsts[0] = None
    order = sorted(firsts)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    size = len(bounds) + 1
    first_id = F.lit([firsts.get(b) if firsts.get(b) is not None else 0 for b in range(size)])
    is_first = F.col("id").eqNullSafe(F.when(F.lit(bool(nulls)) & (F.col("bucket") == 0), F.lit(None).cast("long")).otherwise(F.get(first_id.cast("array<bigint>"), F.col("bucket"))))
    guest = F.get(F.lit([before.get(b, b) for b in range(size)]).cast("array<int>"), F.col("bucket"))
    place = lambda b, g: F.struct(b.cast("int").alias("bucket"), F.lit(g).alias("guest"))
    places = F.when(is_first, F.array(place(F.col("bucket"), 0), place(guest, 1))).otherwise(F.array(place(F.col("bucket"), 0)))
    rows = own.withColumn("place", F.explode(places)).select("id", "text", "place.*").repartition(n, "bucket")
    rows = prepared(rows.withColumn("digest", F.xxhash64("text")))
    following = Window.partitionBy("bucket").orderBy("guest", F.col("id").asc_nulls_first(), "digest")
    new = [c for c in rows.columns if c not in ("id", "bucket", "guest", "digest")]
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(following) for c in new})
    return rows.filter("guest = 0").drop("bucket", "guest", "digest")


def edited(text: Column, following: Column) -> Column:
    """The text with its last quarter replaced by as much of the start of another."""
    n = F.length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    One row per row of docs; a NULL text is empty. Equal texts have equal fingerprints.
    An empty table gives no rows.
    """
    rows = with_next(docs, doc_id, text, lambda df: with_fingerprint(df, "text", "fp"))
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.select(
        "id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "edited", "fp", "next_fp",
    )
    rows = with_fingerprint(rows, "edited", "edited_fp")
    return rows.select(
        "id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
