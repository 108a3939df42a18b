"""Corpus curation: cleaning filters, sampling, union, removal of copies, splits."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsieve.functions.text import NOT_SPACE, SPACE, blank_separated, clean_corpus, concat_text, strip
from mailsieve.rules.verdicts import FIRST_QUOTAS, MIN_TEXT_LENGTH, QUOTAS
from mailsieve.session import small_side, written

# Leading hex digits of a hash key used as histogram bucket.
_BUCKET_DIGITS = 4


def tag(df: DataFrame, label: int, source: str, email_type: str) -> DataFrame:
    """Provenance columns of one corpus."""
    return df.withColumns(
        {"label": F.lit(label), "source": F.lit(source), "email_type": F.lit(email_type)}
    )


def resolve_text(df: DataFrame) -> DataFrame:
    """Add ``text`` from whatever columns a corpus has.

    text_combined wins; then subject and body joined; then text; then body; else ''.
    """
    names = set(df.columns)
    if "text_combined" in names:
        return df.withColumn("text", F.col("text_combined"))
    if {"subject", "body"} <= names:
        return df.withColumn("text", concat_text(F.col("subject"), F.col("body")))
    if "text" in names:
        return df
    if "body" in names:
        return df.withColumn("text", F.coalesce("body", F.lit("")))
    return df.withColumn("text", F.lit(""))


def by_label(df: DataFrame, label: int) -> DataFrame:
    return df.filter(F.col("label") == label)


def clean(df: DataFrame) -> DataFrame:
    return df.withColumn("text", clean_corpus(F.col("text")))


def min_length(df: DataFrame, longer_than: int = MIN_TEXT_LENGTH) -> DataFrame:
    return df.filter(F.char_length("text") > longer_than)


def clean_long(df: DataFrame, longer_than: int = MIN_TEXT_LENGTH) -> DataFrame:
    """min_length(clean(df)), each text cleaned once: a filter on the cleaned text goes below
    the projection, and with it everything the text is made of, read anew at each mention."""
    long = F.filter(F.array(clean_corpus(F.col("text"))), lambda t: F.char_length(t) > longer_than)
    return df.select(*[F.explode(long).alias(c) if c == "text" else F.col(c) for c in df.columns])


def flatten_strings(df: DataFrame) -> DataFrame:
    """Collapse white space in every string column; NULL stays NULL."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns(
        {c: strip(F.regexp_replace(F.col(c), f"{SPACE}+", " ")) for c in strings}
    )


def cap_rows(df: DataFrame, n: int, key: str) -> DataFrame:
    """First n rows in the order of a key (the row limit of a scan, made explicit)."""
    return df.orderBy(key).limit(n)


def split_valid(
    df: DataFrame, min_chars: int = 1, url: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected requests; the rejected ones with a reason. Narrow."""
    reason = F.when(
        F.char_length(F.coalesce("text", F.lit(""))) < min_chars,
        F.lit(f"text must have at least {min_chars} character(s)"),
    )
    if url is not None:
        is_http = F.startswith(url, F.lit("http://")) | F.startswith(url, F.lit("https://"))
        reason = F.coalesce(
            reason,
            F.when(
                ~F.coalesce(is_http, F.lit(False)), F.lit("url must start with http:// or https://")
            ),
        )
    marked = df.withColumn("reason", reason)
    return (
        marked.filter(F.col("reason").isNull()).drop("reason"),
        marked.filter(F.col("reason").isNotNull()),
    )


def attrition(df: DataFrame, longer_than: int = MIN_TEXT_LENGTH) -> DataFrame:
    """Rows before cleaning, removed as short, removed as copies, left over.

    Copies are counted on a digest of the text, combined before the shuffle.
    """
    per_text = (
        clean(df)
        .select(
            F.sha2("text", 256).alias("digest"),
            (F.char_length("text") > longer_than).alias("long"),
        )
        .groupBy("digest", "long")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    kept = F.col("long")
    return per_text.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(~kept, F.col("n"))), F.lit(0)).alias("removed_short"),
        F.coalesce(F.sum(F.when(kept, F.col("n") - 1)), F.lit(0)).alias("removed_duplicates"),
        F.count_if(kept).alias("remaining"),
    )


def hash_key(seed: int, key: str) -> Column:
    """Hex key that shuffles rows the same way on every engine and partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def _rank_cuts(keyed: DataFrame, by: list[str], targets: Column) -> DataFrame:
    """Hash key at given ranks of each group: by..., cut, cut_key.

    keyed has the group columns and _key; targets is an array of struct(cut, target) that
    may use ``total``. A histogram of leading key digits finds the bucket of each rank;
    only the rows of that bucket are then put in order, so no task ever sees a whole group.
    """
    bucket = F.substring("_key", 1, _BUCKET_DIGITS)
    histogram = keyed.groupBy(*by, bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    # At most 16**digits rows per group from here on.
    sums = histogram.withColumns(
        {
            "_upto": F.sum("_n").over(Window.partitionBy(*by).orderBy("_bucket")),
            "total": F.sum("_n").over(Window.partitionBy(*by)),
        }
    )
    wanted = sums.select("*", F.inline(targets)).filter(
        (F.col("target") > F.col("_upto") - F.col("_n")) & (F.col("target") <= F.col("_upto"))
    )
    wanted = wanted.select(
        *by, "_bucket", "cut", (F.col("target") - F.col("_upto") + F.col("_n")).alias("_place")
    )
    inside = keyed.withColumn("_bucket", bucket).join(_settled(wanted), [*by, "_bucket"])
    order = Window.partitionBy(*by, "cut").orderBy("_key")
    return (
        inside.withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") == F.col("_place"))
        .select(*by, "cut", F.col("_key").alias("cut_key"))
    )


def _settled(cuts: DataFrame) -> DataFrame:
    """Cuts as a written table: a few rows per group, broadcast if that is small."""
    return small_side(written(cuts, "cuts"))


def _up_to_quota(df: DataFrame, seed: int, key: str, by: list[str]) -> DataFrame:
    """Rows with a ``quota`` column, cut to the quota of their group by hash of the key."""
    keyed = df.withColumn("_key", hash_key(seed, key))
    target = F.array(
        F.struct(
            F.lit("n").alias("cut"),
            F.least(F.col("quota").cast("bigint"), F.col("total")).alias("target"),
        )
    )
    cuts = _rank_cuts(keyed.select(*by, "quota", "_key"), [*by, "quota"], target)
    limits = _settled(cuts.select(*by, "cut_key"))
    kept = keyed.join(limits, by).filter(F.col("_key") <= F.col("cut_key"))
    return kept.drop("_key", "cut_key", "quota")


def sample_n(df: DataFrame, n: int, seed: int, key: str, by: list[str] | None = None) -> DataFrame:
    """At most n rows per group, chosen by hash of the unique key.

    The rows are filtered in place by the hash at rank n of their group; texts do not move.
    """
    return _up_to_quota(df.withColumn("quota", F.lit(n)), seed, key, by or ["source"])


def quota_table(spark: SparkSession, version: int = 2) -> DataFrame:
    """Rows wanted per source and label, as of the second or the first version."""
    rows = {1: FIRST_QUOTAS, 2: QUOTAS}[version]
    return spark.createDataFrame(rows, "source string, label int, quota int")


def sample_quota(
    df: DataFrame, quotas: DataFrame, seed: int, key: str, by: list[str] | None = None
) -> DataFrame:
    """As sample_n with a quota per group; groups without quota are left out."""
    by = by or ["source", "label"]
    return _up_to_quota(df.join(small_side(quotas), by), seed, key, by)


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """All corpora with their place in the list as source_rank."""
    ranked = [f.withColumn("source_rank", F.lit(i)) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def dedup_exact(df: DataFrame, order: list[str], text: str = "text") -> DataFrame:
    """First row of each text in the given total order; rows equal in text and order stay.

    Only digests and order columns are grouped, and copies combine before the shuffle, so
    a text that makes up a third of the corpus costs one row per task. The rows are kept
    by a semi join on their digest and place.
    """
    digest = F.unhex(F.sha2(F.col(text), 256))
    place = F.struct(*order)
    firsts = df.groupBy(digest.alias("_digest")).agg(F.min(place).alias("_place"))
    firsts = firsts.select("_digest", *[F.col(f"_place.{c}").alias(f"_first_{c}") for c in order])
    firsts = small_side(written(firsts, "firsts"))
    keyed = df.withColumn("_digest", digest)
    same = keyed["_digest"].eqNullSafe(firsts["_digest"])
    for c in order:
        same = same & keyed[c].eqNullSafe(firsts[f"_first_{c}"])
    return keyed.join(firsts, same, "left_semi").drop("_digest")


def _words_of(text: str) -> Column:
    return F.filter(blank_separated(F.lower(text)), lambda t: t != "")


def _word_hashes(text: str) -> Column:
    return F.transform(_words_of(text), lambda t: F.xxhash64(t))


def _run_digests(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """key, _tokens and _digests: the distinct runs of n words as md5 in hex."""
    tokens = df.select(F.col(key), _words_of(text).alias("_tokens"))
    runs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("_tokens") - (n - 1), F.lit(1))),
        lambda i: F.md5(F.array_join(F.slice("_tokens", i, n), " ")),
    )
    return tokens.withColumn("_digests", F.array_distinct(runs))


def word_runs(df: DataFrame, key: str, text: str = "text", n: int = 5) -> DataFrame:
    """key and _runs, the digests of the distinct runs of n words; NULL without words.

    Digests are told apart as strings, by hash: of binaries Spark compares every two elements
    of an array, so a long text costs the square of its words.
    """
    hashed = _run_digests(df, key, text, n)
    distinct = F.transform("_digests", lambda r: F.unhex(r))
    return hashed.select(key, F.when(F.size("_tokens") > 0, distinct).alias("_runs"))


# Bytes of text whose runs meet in one group, and runs that a task packs at a time.
GROUP_BYTES, PACKED_RUNS = 32 << 20, 1 << 21
# Pairs of copies that go to every task; beyond, their texts are dealt out by row.
MOST_PAIRS = 1_000_000


def _some_runs(packed, most: int, sizes):
    """packed for every so many runs of the batches, at least one row at a time."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("_runs")))
            begin = 0
            ends = np.cumsum(sizes(batch.column("_runs")))
            while begin < len(ends):
                before = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, before + most - n, "right")))
                held.append(batch.slice(begin, end - begin))
                n, begin = n + ends[end - 1] - before, end
                if n >= most or begin < len(ends):
                    yield from packed(held)
                    held, n = [], 0
        if held:
            yield from packed(held)

    return run


def _pack_runs(parts: int, key: str, most: int):
    """Map side of shingle_overlap: the runs of a few rows as one blob per range of digests.

    Of rows that share a run the first sends it. What a row is left with goes under a
    negative part; there and in the blobs a row is its key and its number of runs.
    """

    def packed(batches):
        table = pa.Table.from_batches(batches).combine_chunks()
        keys, runs = table.column(key).combine_chunks(), table.column("_runs").combine_chunks()
        size = pc.binary_length(runs).to_numpy() // 16
        digest = np.frombuffer(b"".join(runs.to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64)
        rank = pc.rank(keys, tiebreaker="dense").to_numpy().astype(np.int64)
        # Rows with equal key and size are one; their numbers follow the order of rows.
        order = np.lexsort((size, rank))
        new = np.concatenate([[True], (np.diff(rank[order]) != 0) | (np.diff(size[order]) != 0)])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        keys, size, row = keys.take(pa.array(order[new])), size[order[new]].astype(np.int32), np.repeat(number, size)
        order = np.lexsort((row, digest[:, 1], digest[:, 0]))
        digest, row = digest[order], row[order]
        first = np.concatenate([[True], (digest[1:] != digest[:-1]).any(axis=1)])
        digest, row = digest[first], row[first]
        part = ((digest[:, 0] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        left = np.bincount(row, minlength=len(size))
        # The rows of a range stand together already; its runs go row by row.
        order = np.lexsort((row, part))
        digest, row, part = digest[order], row[order], part[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
        groups = [(-1 - int(part[0]), np.arange(len(size)), left, digest[:0])]
        for i, j in zip(cuts[:-1], cuts[1:]):
            held, times = np.unique(row[i:j], return_counts=True)
            groups.append((int(part[i]), held, times, digest[i:j]))
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        blobs = []
        for _, held, times, runs in groups:
            rows = pa.record_batch([keys.take(pa.array(held)), pa.array(size[held]), pa.array(times.astype(np.int32))], names=["key", "runs", "n"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
                out.write_batch(rows)
            low = (runs[:, 0] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + runs[:, 1].tobytes()
            blobs.append(np.uint32(len(runs)).tobytes() + low + sink.getvalue().to_pybytes())
        yield pa.record_batch([pa.array([g[0] for g in groups], pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])

    return _some_runs(packed, most, lambda runs: pc.binary_length(runs).to_numpy().astype(np.int64) // 16)


def _lost_runs(key: str):
    """Reduce side: what rows were left with, and less one for each run that an earlier
    row in the range holds."""

    def run(group: pa.Table) -> pa.Table:
        blobs = group.column("blob").to_pylist()
        sizes = [int(np.frombuffer(b, np.uint32, 1)[0]) for b in blobs]
        rows = pa.concat_tables(pa.ipc.open_stream(pa.py_buffer(b)[4 + 12 * n :]).read_all() for b, n in zip(blobs, sizes))
        keys, runs, n = (rows.column(c).combine_chunks() for c in ("key", "runs", "n"))
        if group.column("part")[0].as_py() < 0:
            ones = pa.array(np.ones(len(n), np.int64))
            return pa.table([keys, runs, n.cast(pa.int64()), ones], names=[key, "runs", "kept", "times"])
        high = np.concatenate([np.frombuffer(b, np.uint32, m, 4) for b, m in zip(blobs, sizes)])
        low = np.concatenate([np.frombuffer(b, np.uint64, m, 4 + 4 * m) for b, m in zip(blobs, sizes)])
        size, rank = runs.to_numpy(), pc.rank(keys, tiebreaker="dense").to_numpy().astype(np.int64)
        place = np.lexsort((size, rank))
        new = np.concatenate([[True], (np.diff(rank[place]) != 0) | (np.diff(size[place]) != 0)])
        number = np.empty(len(place), np.int64)
        number[place] = np.cumsum(new) - 1
        first_at = place[new]
        row = np.repeat(number, n.to_numpy())
        order = np.lexsort((row, high, low))
        high, low, row = high[order], low[order], row[order]
        begins = np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
        owner = row[np.maximum.accumulate(np.where(begins, np.arange(len(row)), 0))]
        lost = np.bincount(row[row != owner], minlength=len(first_at))
        at = np.flatnonzero(lost)
        taken = pa.array(first_at[at])
        return pa.table([keys.take(taken), runs.take(taken), pa.array(-lost[at].astype(np.int64)), pa.array(np.zeros(len(at), np.int64))], names=[key, "runs", "kept", "times"])

    return run


def shingle_overlap(df: DataFrame, key: str, text: str = "text", n: int = 5) -> DataFrame:
    """Share of each row's word runs that occur in an earlier row: key, new_runs, overlap.

    A run is n blank-separated words, lower case; shorter texts are one run, texts without
    words have none and overlap 0. Each run is credited to its first row; a row's overlap
    is what it was not credited with. Runs travel packed, some thousand rows' runs to a blob
    per range of digests, and are combined before: a run found in every third row goes once
    per blob, and no pairs are built. Back come only the runs that a row loses.
    """
    spark = df.sparkSession
    n_bytes = df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // GROUP_BYTES)
    kind = dict(df.dtypes)[key]
    hashed = _run_digests(df.filter(F.col(key).isNotNull()), key, text, n)
    joined = F.when(F.size("_tokens") > 0, F.unhex(F.array_join("_digests", "")))
    sent = hashed.select(key, joined.alias("_runs")).mapInArrow(_pack_runs(parts, key, PACKED_RUNS), "part int, blob binary")
    kept = sent.groupBy("part").applyInArrow(_lost_runs(key), f"`{key}` {kind}, runs int, kept long, times long")
    # A row that is there several times counts as often.
    counts = kept.groupBy(key, "runs").agg(F.expr("sum(kept) div sum(times)").alias("new_runs"))
    out = df.select(key, F.rlike(text, F.lit(NOT_SPACE)).alias("_has_words")).join(
        counts.filter("new_runs > 0"), key, "left"
    )
    missing = F.when(F.col("_has_words"), F.lit(1.0)).otherwise(F.lit(0.0))
    return out.select(
        key,
        F.coalesce("new_runs", F.lit(0).cast("bigint")).alias("new_runs"),
        F.coalesce(F.lit(1.0) - F.col("new_runs") / F.col("runs"), missing).alias("overlap"),
    )


def _zipped(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _hashed_runs(words: np.ndarray, size: np.ndarray, n: int):
    """Row and two hashes of every run of n words; the words, as hashes, follow each other
    row by row, size of them in a row. Fewer than n are one run."""
    ends = np.cumsum(size)
    starts = np.maximum(size - n, 0) + 1
    row = np.repeat(np.arange(len(size), dtype=np.int32), starts)
    at = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts) + (ends - size)[row]
    end = ends[row]
    hashes = [np.full(len(row), seed, np.uint64) for seed in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]
    for k in range(n):
        word = np.where(at + k < end, words[np.minimum(at + k, len(words) - 1)], np.uint64(k))
        for i, factor in enumerate((0xBF58476D1CE4E5B9, 0x94D049BB133111EB)):
            mixed = (hashes[i] ^ word) * np.uint64(factor)
            hashes[i] = mixed ^ (mixed >> np.uint64(29 + 3 * i))
    return row, *hashes


def _pack_holders(parts: int, key: str, n: int, most: int):
    """Map side of nearest_copy: who holds which runs, as one blob per range of hashes.

    A run goes once per blob, with the first of the rows that share it; the others name its
    place in the blob, which packs well, as copies name one place after the other.
    """

    def packed(batches):
        table = pa.Table.from_batches(batches).combine_chunks()
        # Rows are numbered in the order of keys.
        table = table.sort_by(key).combine_chunks()
        keys, words = table.column(key).combine_chunks(), table.column("_runs").combine_chunks()
        size = pc.list_value_length(words).to_numpy().astype(np.int64)
        row, high, digest = _hashed_runs(words.flatten().to_numpy().view(np.uint64), size, n)
        part = (((high >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int32)
        order = np.lexsort((row, digest, part))
        row, part, digest = row[order], part[order], digest[order]
        once = np.concatenate([[True], (row[1:] != row[:-1]) | (digest[1:] != digest[:-1]) | (part[1:] != part[:-1])])
        row, part, digest = row[once], part[once], digest[once]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
        numbers, blobs = [], []
        for i, j in zip(cuts[:-1], cuts[1:]):
            first = np.concatenate([[True], digest[i + 1 : j] != digest[i : j - 1]])
            own, run = row[i:j][first], np.cumsum(first) - 1
            by_row = np.argsort(own, kind="stable")
            place = np.empty(len(own), np.int64)
            place[by_row] = np.arange(len(own))
            again, named = row[i:j][~first], place[run[~first]]
            order = np.lexsort((named, again))
            held, at = np.unique(np.concatenate([own, again]), return_inverse=True)
            rows = pa.record_batch(
                [keys.take(pa.array(held)), *[pa.array(np.bincount(x, minlength=len(held)).astype(np.int32)) for x in (at[: len(own)], at[len(own) :])]],
                names=["key", "own", "again"],
            )
            steps = np.diff(named[order], prepend=0).astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes()
            steps = pa.compress(steps, "zstd", asbytes=True)
            head = np.array([len(own), len(again), len(steps)], np.uint32).tobytes()
            numbers.append(int(part[i]))
            blobs.append(head + digest[i:j][first][by_row].tobytes() + steps + _zipped(rows))
        yield pa.record_batch([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])

    return _some_runs(packed, most, lambda words: pc.list_value_length(words).to_numpy().astype(np.int64))


def _credited(parts: int):
    """Reduce side: how many runs of a range a row has from which first owner, as one blob
    per bucket of rows."""

    def run(group: pa.Table) -> pa.Table:
        rows, digests, named, begin = [], [], [], 0
        for blob in group.column("blob").to_pylist():
            own, again, packed = (int(x) for x in np.frombuffer(blob, np.uint32, 3))
            at = 12 + 8 * own
            steps = np.frombuffer(pa.decompress(blob[at : at + packed], 4 * again, "zstd", asbytes=True), np.uint8)
            digests.append(np.frombuffer(blob, np.uint64, own, 12))
            named.append(begin + np.cumsum(np.ascontiguousarray(steps.reshape(4, -1).T).view(np.int32).ravel(), dtype=np.int64))
            rows.append(pa.ipc.open_stream(pa.py_buffer(blob)[at + packed :]).read_all())
            begin += own
        rows = pa.concat_tables(rows).combine_chunks()
        keys, own, again = (rows.column(c).combine_chunks() for c in ("key", "own", "again"))
        _, at, number = np.unique(pc.rank(keys, tiebreaker="dense").to_numpy(), return_index=True, return_inverse=True)
        keys, number = keys.take(pa.array(at)), number.astype(np.int64)
        row, digest = np.repeat(number, own.to_numpy()), np.concatenate(digests)
        order = np.lexsort((row, digest))
        digest = digest[order]
        begins = np.concatenate([[True], digest[1:] != digest[:-1]])
        owner = np.empty(len(row), np.int64)
        owner[order] = row[order][np.maximum.accumulate(np.where(begins, np.arange(len(row)), 0))]
        row = np.concatenate([row, np.repeat(number, again.to_numpy())])
        owner = np.concatenate([owner, owner[np.concatenate(named)]])
        taken = row != owner
        pair, n = np.unique(row[taken] * len(keys) + owner[taken], return_counts=True)
        row, owner = np.divmod(pair, max(len(keys), 1))
        held = keys.take(pa.array(np.unique(row)))
        # All ranges must deal a key alike, so its bucket hangs on its value only.
        bucket = (pd.util.hash_array(held.to_numpy(zero_copy_only=False), categorize=False) % np.uint64(parts)).astype(np.int64)
        bucket = np.repeat(bucket, np.unique(row, return_counts=True)[1])
        order = np.argsort(bucket, kind="stable")
        row, owner, n, bucket = row[order], owner[order], n[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(bucket) else []
        blobs = [
            _zipped(pa.record_batch([keys.take(pa.array(row[i:j])), keys.take(pa.array(owner[i:j])), pa.array(n[i:j].astype(np.int32))], names=["key", "other", "n"]))
            for i, j in zip(cuts[:-1], cuts[1:])
        ]
        return pa.table([pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    return run


def _most_credited(key: str):
    """Per row the owner it has most runs from, the first of several."""

    def run(group: pa.Table) -> pa.Table:
        rows = pa.concat_tables(pa.ipc.open_stream(pa.py_buffer(b)).read_all() for b in group.column("blob").to_pylist())
        rows = rows.group_by(["key", "other"]).aggregate([("n", "sum")])
        rows = rows.sort_by([("key", "ascending"), ("n_sum", "descending"), ("other", "ascending")]).combine_chunks()
        keys = rows.column("key").combine_chunks()
        new = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
        best = rows.take(pa.array(np.flatnonzero(np.concatenate([[True], new]))))
        return pa.table([best.column("key"), best.column("other")], names=[key, "other"])

    return run


def nearest_copy(df: DataFrame, key: str, text: str = "text", n: int = 5) -> DataFrame:
    """Per row the earlier row that first held most of its runs: key, other, similarity.

    Only first owners are compared: a later row that is more like it, but took its runs
    from earlier ones, is not found. Every run is credited to its first row; the earlier row credited with most runs of a
    row (the first of several) is compared with it, and the similarity is the exact
    Jaccard of their runs. One pair per row at most, so a group of copies gives no pairs
    of pairs. Rows that share no run with an earlier one are left out.

    Runs travel packed as in shingle_overlap, told apart by 64 bits within a range of
    hashes, and so do the counts per row and owner. The pairs are compared on their texts,
    where 64 bits tell a word and a run apart.
    """
    spark = df.sparkSession
    texts = df.filter(F.col(key).isNotNull() & F.rlike(text, F.lit(NOT_SPACE))).select(key, F.col(text).alias("_text"))
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // GROUP_BYTES)
    kind = dict(df.dtypes)[key]
    words = texts.select(key, _word_hashes("_text").alias("_runs"))
    sent = words.mapInArrow(_pack_holders(parts, key, n, PACKED_RUNS), "part int, blob binary")
    counted = sent.groupBy("part").applyInArrow(_credited(parts), "bucket int, blob binary")
    best = counted.groupBy("bucket").applyInArrow(_most_credited(key), f"`{key}` {kind}, other {kind}")
    pairs = written(best, "pairs")
    others = pairs.select("other").distinct()

    def runs(words: str) -> Column:
        # Of numbers, which meet by hash; a slice per run would copy all words each time.
        places = F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0)))
        return F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))

    def sized(rows: DataFrame) -> DataFrame:
        hashed = rows.withColumn("_words", _word_hashes("_text"))
        return hashed.withColumn("_size", F.size(F.array_distinct(runs("_words")))).drop("_words")

    mine = sized(texts.join(small_side(pairs, MOST_PAIRS), key))
    theirs = texts.withColumnRenamed(key, "other").join(small_side(others, MOST_PAIRS), "other", "left_semi")
    theirs = sized(theirs).withColumnsRenamed({"_text": "_others", "_size": "_other_size"})
    both = mine.join(theirs, "other").withColumns({"_words": _word_hashes("_text"), "_others": _word_hashes("_others")})
    common = F.size(F.array_intersect(runs("_words"), runs("_others")))
    return both.select(key, "other", (common / (F.col("_size") + F.col("_other_size") - common)).alias("similarity"))


def dedup_near(
    df: DataFrame, key: str, threshold: float = 0.8, text: str = "text", n: int = 5
) -> DataFrame:
    """Drop rows of whose word n-grams a share >= threshold occurs in earlier rows.

    This is coverage by all earlier rows together, so a row quoted in a longer one goes
    too; nearest_copy compares two rows. key is unique and gives the order; the first of
    several copies is kept.
    """
    copies = shingle_overlap(df, key, text, n).filter(F.col("overlap") >= threshold)
    return df.join(copies.select(key), key, "left_anti")


def stratified_split(
    df: DataFrame, seed: int, key: str, train: float = 0.8, validation: float = 0.1,
    label: str = "label",
) -> DataFrame:
    """Add ``split``: exact shares per label after a seeded shuffle within the label.

    The cuts are int(train*n) and int((train+validation)*n) of the hash order; rows are
    compared with the two cut keys of their label in place.
    """
    keyed = df.withColumn("_key", hash_key(seed, key))
    total = F.col("total")
    targets = F.array(
        F.struct(
            F.lit("train").alias("cut"), F.floor(F.lit(train) * total).alias("target")
        ),
        F.struct(
            F.lit("validation").alias("cut"),
            F.floor(F.lit(train + validation) * total).alias("target"),
        ),
    )
    cuts = _rank_cuts(keyed.select(label, "_key"), [label], targets)
    per_label = cuts.groupBy(label).agg(
        *[
            F.coalesce(F.max(F.when(F.col("cut") == c, F.col("cut_key"))), F.lit("")).alias(f"_{c}")
            for c in ("train", "validation")
        ]
    )
    joined = keyed.join(_settled(per_label), label, "left")
    split = (
        F.when(F.col("_key") <= F.col("_train"), "train")
        .when(F.col("_key") <= F.col("_validation"), "validation")
        .otherwise("test")
    )
    return joined.withColumn("split", split).drop("_key", "_train", "_validation")


def split_balance(df: DataFrame) -> DataFrame:
    return df.groupBy("split", "label").agg(F.count(F.lit(1)).alias("emails"))


def balance_classes(df: DataFrame, seed: int, key: str, mode: str = "weight") -> DataFrame:
    """Even out the labels: a ``weight`` of n/(k*n_c), or the smallest class size for all."""
    counts = written(df.groupBy("label").agg(F.count(F.lit(1)).alias("_n")), "classes")
    everyone = Window.partitionBy(F.lit(1))  # one row per label
    if mode == "weight":
        weights = counts.select(
            "label",
            (F.sum("_n").over(everyone) / (F.count(F.lit(1)).over(everyone) * F.col("_n"))).alias(
                "weight"
            ),
        )
        return df.join(small_side(weights), "label")
    quotas = counts.select("label", F.min("_n").over(everyone).alias("quota"))
    return sample_quota(df, quotas, seed, key, ["label"])


def counts_by_label(df: DataFrame) -> DataFrame:
    """Rows per label 0 and 1, also where a label is absent."""
    per_label = [
        F.struct(F.lit(v).alias("label"), F.count_if(F.col("label") == v).alias("emails"))
        for v in (0, 1)
    ]
    return df.agg(F.array(*per_label).alias("rows")).select(F.inline("rows"))


def counts_by_source(df: DataFrame) -> DataFrame:
    """Rows per source, most frequent first."""
    counts = df.groupBy("source").agg(F.count(F.lit(1)).alias("emails"))
    return counts.orderBy(F.desc("emails"), "source")


def source_x_label(df: DataFrame) -> DataFrame:
    """Rows per source (down) and label (across)."""
    return df.groupBy("source").agg(
        F.count_if(F.col("label") == 0).alias("label_0"),
        F.count_if(F.col("label") == 1).alias("label_1"),
    )


def corpus_overview(df: DataFrame) -> DataFrame:
    """Rows, characters and share of label 1 per source."""
    return df.groupBy("source").agg(
        F.count(F.lit(1)).alias("emails"),
        F.sum(F.char_length("text")).alias("characters"),
        F.avg("label").alias("phishing_share"),
    )
