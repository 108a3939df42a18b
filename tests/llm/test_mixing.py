"""Targets against the reshare loop, and what the mix takes."""

import math
import random

from pyspark.sql import functions as F

from mailsieve.llm import mixing as M


def plain_targets(sizes):
    """Share by weight, cut at three times the size, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, target, open_ = float(sum(sizes.values())), {}, set(order)
    while open_:
        total = sum(w[s] for s in open_)
        capped = {s for s in open_ if left * w[s] / total >= 3 * sizes[s]}
        if not capped:
            return target | {s: left * w[s] / total for s in open_}
        for s in capped:
            target[s] = 3.0 * sizes[s]
        left -= sum(target[s] for s in capped)
        open_ -= capped
    return target


def corpus(spark, sizes, seed=0):
    rng, rows = random.Random(seed), []
    for source, size in sizes.items():
        while size > 0:
            n = min(size, rng.randint(1, 40))
            rows.append((len(rows), " ".join(["w"] * n), source))
            size -= n
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_and_budgets(spark):
    for sizes in (
        {"a": 900, "b": 30, "c": 5000, None: 40, "d": 10},
        {"a": 10, "b": 10, "c": 10},
        {"ü": 100, "z": 3000, "é": 1, "𝒳": 77},
    ):
        want = plain_targets(sizes)
        out = M.mix(corpus(spark, sizes)).collect()
        per = {}
        for r in out:
            assert abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
            assert r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
            per[r.source] = per.get(r.source, 0) + r.taken
        for source, taken in per.items():
            assert abs(taken - want[source]) <= 40


def test_complete_epochs_come_first(spark):
    out = M.mix(corpus(spark, {"a": 4000, "b": 1000})).groupBy("source").agg(F.min("copies"), F.max("copies")).collect()
    assert all(r[2] - r[1] <= 1 for r in out)


def test_reruns_agree_and_weights_count(spark):
    df = corpus(spark, {"a": 4000, "b": 900, "c": 30})
    one = {(r.doc_id, r.taken) for r in M.mix(df).collect()}
    assert one == {(r.doc_id, r.taken) for r in M.mix(df.repartition(7)).collect()}
    heavy = M.mix(df, F.when(F.col("doc_id") % 2 == 0, 50.0).otherwise(1.0)).filter("source = 'a' AND copies > 0")
    assert heavy.filter("doc_id % 2 = 0").count() > 2 * heavy.filter("doc_id % 2 = 1").count()


def test_edges(spark):
    rows = [(None, None, None, 1), (1, "", "s", 2), (1, "a b", "s", 3), (1, "a b", "s", 3), (2, "c " * 9000, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    assert M.mix(df).count() == 5
    assert M.mix(df.limit(0)).count() == 0
    assert M.mix(df.filter("text IS NULL")).collect()[0].taken == 0
    again = M.repeat(df)
    assert again.columns == df.columns


def test_repeat_gives_rows_as_often_as_the_mix_takes_them(spark):
    df = corpus(spark, {"a": 500, "b": 60, "c": 70})
    want = M.mix(df).agg(F.sum("copies")).first()[0]
    assert M.repeat(df).count() == want


def test_repeat_of_equal_rows(spark):
    """100 equal rows of which the mix takes a part come out as that part, spread over partitions."""
    rows = [(7, "w w w", "a", i % 3) for i in range(100)] + [(None, "x y", "a", 1)] * 30 + [(i + 100, "w " * 50, "b", 0) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, note int").repartition(9)
    want = {(r.doc_id, r.source): r.n for r in M.mix(df).groupBy("doc_id", "source").agg(F.sum("copies").alias("n")).collect()}
    got = {(r.doc_id, r.source): r.n for r in M.repeat(df).groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {k: n for k, n in want.items() if n} and 0 < want[(7, "a")] and want[(7, "a")] % 100


def test_rows_without_id_are_a_sample(spark):
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.col("id"), F.repeat(F.lit(" w"), (F.col("id") % 20).cast("int"))).alias("text"), F.when(F.col("id") < 2900, "a").otherwise("b").alias("source"))
    out = M.mix(df).filter("source = 'a'")
    sizes = {r.copies: r.s for r in out.groupBy("copies").agg(F.avg("size").alias("s")).collect()}
    assert len(sizes) == 2 and max(sizes.values()) - min(sizes.values()) < 1.5


def test_buckets_are_bounded_for_any_weight(spark):
    """No bucket holds far more rows than it should, whatever the weights are."""
    n = 100_000
    ids = spark.range(n)
    weights = {"small": F.lit(0.05), "one": F.lit(1.0), "large": F.lit(50.0), "mixed": F.when(F.col("id") % 3 == 0, 0.05).otherwise(F.when(F.col("id") % 3 == 1, 1.0).otherwise(50.0))}
    for weight in weights.values():
        key = M.key_of(F.col("id"), weight, 0, F.lit(""), F.lit("s"))
        largest = ids.select(F.floor(F.log(key) * (n / (math.e * M.BUCKET_ROWS))).alias("b")).groupBy("b").count().agg(F.max("count")).first()[0]
        assert largest < 1.15 * M.BUCKET_ROWS
