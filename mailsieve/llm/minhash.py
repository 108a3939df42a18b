"""Near-duplicate documents by improved consistent weighted sampling.

A document is the set of its word 5-grams (shingles), each weighing its count in the text
times ln((N + 1) / df), with df over all documents. Two documents are linked if their
weighted Jaccard similarity is at least the threshold, and linked documents form classes.

1. Shingle hashes of all texts meet by hash range, packed into blobs: one entry per shingle
   and distinct text of a piece of input, so copies are combined before they move. This
   counts df and tells shared shingles from those of a single text.
2. Shared shingles return to their text. A link needs shared shingles with at least the
   threshold's share of a text's weight, which most texts lack: these end here. The
   shingles that only this text holds can match nothing, so one term with all their
   weight stands for them.
3. Weighted samples of the others are banded. In each bucket every text is a candidate with
   the smallest one. Buckets that still hold several classes are looked at twice more: first
   each text outside the smallest one's class is a candidate with the one text of another
   class that agrees with it in most samples, and then with all texts of the classes that
   are still others.
4. Each text carries the weight its shared shingles have in each of SLOTS ranges of hashes.
   The smaller weights of two texts, summed over the ranges, are at least what they share,
   so a candidate goes without a look at its terms only where it can't be similar. The
   others are verified by exact weighted Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.llm import tokens
from mailsieve.llm.graph import components
from mailsieve.session import small_side, written

SIZE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4
# Hash ranges of a text's load; a power of two.
SLOTS = 256
CHUNK = 4096
GROUP_BYTES = 128 << 20
SAMPLES = 1 << 16
# Weights are kept in single precision.
TINY = 1e-6
# For sums of loads in single precision.
SLACK = 1e-5


# Blobs: a few arrays behind their lengths, in one binary value.
def pack(*arrays: np.ndarray) -> bytes:
    return np.array([len(a) for a in arrays], np.uint32).tobytes() + b"".join(a.tobytes() for a in arrays)


def unpack(blob: bytes, *types: type) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, np.uint32, len(types))
    out, at = [], 4 * len(types)
    for n, kind in zip(sizes, types):
        out.append(np.frombuffer(blob, kind, int(n), at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1])


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else values[:0]


ENTRY = (np.int64, np.uint16, np.uint64, np.uint32, np.uint32, np.uint32, np.uint32)
FOUND = (np.int64, np.uint64, np.uint32, np.uint32)
TOTAL = (np.int64, np.uint32, np.uint32)


def _entries(parts: int, size: int):
    """Map side: distinct texts of a piece of input to blobs per hash range.

    Blobs with part < 0 hold (text, shingles, copies) for the text's home group -1 - part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tokens.pieces(batch, "text"):
                keys = piece.column("node").to_numpy()
                node, first, copies = np.unique(keys, return_index=True, return_counts=True)
                w = tokens.words(piece.column("text").take(pa.array(first)))
                hashes, text = tokens.shingles(w, size)
                out = list(_home_rows(node, copies, np.bincount(text, minlength=len(node)), parts))
                out += _range_rows(node, copies, hashes, text, parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], names=["part", "blob"]
                )

    return run


def _home_rows(node, copies, n, parts):
    home = tokens.mix(node.view(np.uint64)) % np.uint64(parts)
    order = np.argsort(home, kind="stable")
    for rows in np.split(order, runs(home[order])[1:]):
        if len(rows):
            yield -1 - int(home[rows[0]]), pack(node[rows], n[rows].astype(np.uint32), copies[rows].astype(np.uint32))


def _range_rows(node, copies, hashes, text, parts):
    order = np.lexsort((hashes, text)) if len(node) > 60_000 else np.argsort((text.astype(np.uint64) << np.uint64(48)) | (hashes >> np.uint64(16)))
    hashes, text = hashes[order], text[order]
    starts = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])])) if len(hashes) else np.zeros(0, np.int64)
    count = np.diff(np.append(starts, len(hashes)))
    hashes, text = hashes[starts], text[starts]
    part = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    part = part.astype(np.uint16 if parts <= 1 << 16 else np.uint32)
    order = np.argsort(part, kind="stable")
    for rows in np.split(order, runs(part[order])[1:]):
        if not len(rows):
            continue
        own = text[rows]
        at = runs(own)
        docs, n = own[at], np.diff(np.append(at, len(own)))
        # Entries of a text beyond 65535 in one range go on under the same text again.
        times = (n + 65534) // 65535
        rest = np.repeat(n, times) - 65535 * (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
        docs, n = np.repeat(docs, times), np.minimum(rest, 65535)
        again, more = np.flatnonzero(count[rows] > 1), np.flatnonzero(copies[docs] > 1)
        yield (
            int(part[rows[0]]),
            pack(
                node[docs], n.astype(np.uint16), hashes[rows], again.astype(np.uint32), count[rows][again].astype(np.uint32),
                more.astype(np.uint32), copies[docs][more].astype(np.uint32),
            ),
        )


def _count(parts: int):
    """Reduce side of one hash range: shared shingles with their df, by home group."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return group[["part", "blob"]].rename(columns={"part": "home"})
        node, hashes, tf, copies = [], [], [], []
        for blob in group.pop("blob"):
            texts, n, h, again, times, more, extra = unpack(blob, *ENTRY)
            t, c = np.ones(len(h), np.uint32), np.ones(len(texts), np.uint32)
            t[again], c[more] = times, extra
            node.append(np.repeat(texts, n))
            copies.append(np.repeat(c, n))
            hashes.append(h)
            tf.append(t)
        node, hashes, tf, copies = map(np.concatenate, (node, hashes, tf, copies))
        order = np.argsort(hashes)
        starts = runs(hashes[order])
        first, last = node[order][starts], np.maximum.reduceat(node[order], starts)
        shared = (np.minimum.reduceat(node[order], starts) != last) | (first != last)
        n = np.diff(np.append(starts, len(order)))
        df = np.repeat(sums(copies[order], starts), n)
        kept = np.repeat(shared, n)
        order, df = order[kept], df[kept]
        node, hashes, tf = node[order], hashes[order], tf[order]
        # The same text may come from several pieces.
        order = np.lexsort((hashes, node))
        fresh = np.concatenate([[True], (node[order][1:] != node[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])])[: len(order)]
        order = order[fresh]
        home = (tokens.mix(node[order].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        by = np.argsort(home, kind="stable")
        out = []
        for rows in np.split(by, runs(home[by])[1:]):
            if len(rows):
                pick = order[rows]
                out.append((int(home[rows[0]]), pack(node[pick], hashes[pick], df[pick].astype(np.uint32), tf[pick])))
        return pd.DataFrame(out, columns=["home", "blob"]).astype({"home": "int32"})

    return run


def icws(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray, samples: int) -> np.ndarray:
    """(texts, samples) array: the weighted sample each text's terms agree on.

    Per term and sample: r and c from Gamma(2, 1), b from U(0, 1), all from the term's hash;
    t = floor(ln w / r + b); the term with the smallest ln c - r (t - b) - r is taken,
    and its hash with t is the sample.
    """
    log_w = np.log(weights)
    n = np.diff(np.append(starts, len(hashes)))
    out = np.empty((len(starts), samples), np.uint64)
    low, unit = np.uint64(0xFFFFFFFF), 1.0 / (1 << 32)
    for k in range(samples):
        seed = hashes + np.uint64((0x632BE59BD9B4E019 * (k + 1)) & 0xFFFFFFFFFFFFFFFF)
        u = [tokens.mix(seed ^ np.uint64(j)) for j in (1, 2, 3)]
        half = [((x >> np.uint64(32)) + 0.5) * unit for x in u] + [((x & low) + 0.5) * unit for x in u[:2]]
        r = -np.log(half[0] * half[1])
        c = -np.log(half[2] * half[3])
        b = half[4]
        t = np.floor(log_w / r + b)
        a = np.log(c) - r * (t - b) - r
        least = np.repeat(np.minimum.reduceat(a, starts), n)
        hit = np.flatnonzero(a == least)
        owner = np.searchsorted(starts, hit, "right") - 1
        pick = hit[runs(owner)]
        out[:, k] = tokens.mix(hashes[pick] ^ tokens.mix(t[pick].astype(np.int64).view(np.uint64)))
    return out


def slot_loads(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A text's weight per range of hashes, in half precision and never below the sum;
    infinite where it is beyond that precision."""
    slot = (hashes >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
    exact = np.bincount(slot, weights.astype(float), SLOTS)
    with np.errstate(over="ignore"):
        half = exact.astype(np.float16)
        return np.where(half < exact, np.nextafter(half, np.float16(np.inf)), half)


def may_link(loads: np.ndarray, weights: np.ndarray, load: np.ndarray, weight, threshold: float) -> np.ndarray:
    """Which rows may reach the threshold with the text, or row by row with the texts, of
    load and weight; never False where they do."""
    least = (threshold - SLACK) / (1 + threshold - SLACK)
    return np.minimum(loads, load).sum(axis=-1, dtype=np.float64) >= least * (weights + weight)


def _loads(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float16).reshape(-1, SLOTS).astype(np.float32)


def _sketch(n_docs: int, threshold: float, bands: int, rows: int):
    """Home side: texts with enough shared weight, their terms and band keys."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        at, found = [], []
        for home, blob in zip(group["home"], group.pop("blob")):
            (at if home < 0 else found).append(unpack(blob, *(TOTAL if home < 0 else FOUND)))
        empty = pd.DataFrame([], columns=["node", "weight", "hashes", "weights", "bands", "code", "load"])
        if not found:
            return empty
        texts, n, copies = (np.concatenate(x) for x in zip(*at))
        order = np.argsort(texts, kind="stable")
        first = runs(texts[order])
        texts, n, copies = texts[order][first], n[order][first].astype(float), sums(copies[order].astype(float), first)
        node, hashes, df, tf = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((hashes, node))
        node, hashes = node[order], hashes[order]
        weights = (tf * np.log((n_docs + 1) / df)).astype(np.float32)[order]
        tf = tf[order].astype(float)
        starts = runs(node)
        i = np.searchsorted(texts, node[starts])
        shared = sums(weights.astype(float), starts)
        rest = np.maximum(n[i] - sums(tf, starts), 0) * np.log((n_docs + 1) / copies[i])
        live = shared >= (threshold - TINY) * (shared + rest)
        if not live.any():
            return empty
        size = np.diff(np.append(starts, len(node)))
        out = []
        picked = np.flatnonzero(live)
        ends = np.cumsum(size[picked])
        for block in np.split(picked, np.flatnonzero(np.diff(ends // SAMPLES)) + 1):
            # The rest of a text's weight is one more term that no other text has.
            terms = [np.append(hashes[starts[j] : starts[j] + size[j]], tokens.mix(node[starts[j] : starts[j] + 1].view(np.uint64))) for j in block]
            loads = [np.append(weights[starts[j] : starts[j] + size[j]].astype(float), rest[j]) for j in block]
            loads = [x if x[-1] > 0 else x[:-1] for x in loads]
            terms = [x[: len(y)] for x, y in zip(terms, loads)]
            where = np.concatenate([[0], np.cumsum([len(x) for x in terms])[:-1]]).astype(np.int64)
            samples = icws(np.concatenate(terms), np.concatenate(loads), where, bands * rows).reshape(len(block), bands, rows)
            # One byte per sample is enough to compare two texts roughly.
            code = samples.astype(np.uint8)
            band = np.zeros((len(block), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
            for r in range(rows):
                band = tokens.mix(band * np.uint64(tokens.BASE) + samples[:, :, r])
            for x, j in enumerate(block):
                own = slice(starts[j], starts[j] + size[j])
                load = slot_loads(hashes[own], weights[own]).tobytes()
                out.append((int(node[starts[j]]), float(shared[j] + rest[j]), hashes[own].tobytes(), weights[own].tobytes(), band[x].view(np.int64), code[x].tobytes(), load))
        return pd.DataFrame(out, columns=list(empty))

    return run


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted Jaccard similarity of the two texts of each row."""
    for batch in batches:
        rows = zip(*[batch.column(c).to_pylist() for c in ("hashes", "weights", "weight", "other_hashes", "other_weights", "other_weight")])
        out = []
        for h, w, total, h2, w2, total2 in rows:
            _, i, j = np.intersect1d(np.frombuffer(h, np.uint64), np.frombuffer(h2, np.uint64), assume_unique=True, return_indices=True)
            least = float(np.minimum(np.frombuffer(w, np.float32)[i], np.frombuffer(w2, np.float32)[j]).sum(dtype=float))
            out.append(least / (total + total2 - least))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], names=["a", "b", "similarity"])


def _possible(threshold: float):
    """Rows whose loads do not rule the threshold out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                one, other = (_loads(batch.column(c).to_pylist()) for c in ("load", "other"))
                w, v = (batch.column(c).to_numpy() for c in ("w", "v"))
                yield batch.select(["a", "b"]).filter(pa.array(may_link(one, w, other, v, threshold)))

    return run


def _across(threshold: float, best: bool):
    """Candidates (a, b) of different classes in buckets, a among the outsiders.

    best: for each outsider the one that agrees with it in most samples, of those that
    may be similar. A pair is given by the first band only whose key is the same in both."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["band", "salt", "outside"], ignore_index=True)
        node, part, outside = group["node"].to_numpy(), group["component"].to_numpy(), group["outside"].to_numpy()
        codes = np.frombuffer(b"".join(group["code"]), np.uint8).reshape(len(group), -1)
        loads, weight = _loads(group.pop("load")), group["weight"].to_numpy()
        place = group[["band", "salt"]].to_numpy()
        number = group["no"].to_numpy()
        keys = None if best or not len(group) else np.stack(group["bands"].to_numpy())
        starts = np.concatenate([[0], np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1, [len(group)]])
        a, b = [], []
        for start, end in zip(starts, starts[1:]):
            first = start + int((~outside[start:end]).sum())
            for i in range(first, end):
                w = weight[start:first]
                alike = np.minimum(w, weight[i]) >= (threshold - TINY) * np.maximum(w, weight[i])
                found = start + np.flatnonzero(alike & (part[start:first] != part[i]))
                if not best and len(found):
                    found = found[(keys[found] == keys[i]).argmax(axis=1) == number[i]]
                found = found[may_link(loads[found], weight[found], loads[i], weight[i], threshold)]
                if best and len(found):
                    found = found[[(codes[found] == codes[i]).sum(axis=1).argmax()]]
                a.append(np.repeat(node[i], len(found)))
                b.append(node[found])
        return pd.DataFrame({"a": np.concatenate(a or [node[:0]]), "b": np.concatenate(b or [node[:0]])}).drop_duplicates()

    return run


def _cross_pairs(members: DataFrame, sketches: DataFrame, labels: DataFrame, threshold: float, best: bool) -> DataFrame:
    """Candidates of different classes. A bucket's members are dealt to chunks, each of
    which meets all members outside the class of the bucket's smallest text. Loads come
    along from sketches, and the keys of all bands where every pair counts."""
    all_ = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    buckets = all_.groupBy("band").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min_by("component", "node").alias("main"),
        F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"),
    )
    several = all_.join(buckets.filter("low <> high").drop("low", "high"), "band")
    more = ["load"] if best else ["load", "bands"]
    several = several.join(sketches.select("node", *more), "node")
    columns = ["band", "no", "salt", "node", "weight", "component", "code", "outside", *more]
    inside = several.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("outside", F.lit(False))
    outside = several.filter("component <> main").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("outside", F.lit(True))
    both = inside.unionByName(outside).select(*columns)
    both = written(both, "buckets")
    groups = both.count() // (4 * CHUNK) + int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.withColumn("to", F.pmod(F.xxhash64("band", "salt"), F.lit(groups)))
    pairs = both.groupBy("to").applyInPandas(_across(threshold, best), "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _links(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that are similar, written."""
    loads = sketches.select("node", "load", "weight")
    rough = pairs.join(loads.toDF("a", "load", "w"), "a").join(loads.toDF("b", "other", "v"), "b")
    rough = written(rough.mapInArrow(_possible(threshold), "a long, b long"), "pairs")
    # The terms of texts without a candidate stay where they are.
    needed = small_side(rough.select(F.col("a").alias("node")).union(rough.select("b")).distinct())
    own = sketches.select("node", "hashes", "weights", "weight").join(needed, "node", "left_semi")
    other = own.toDF("b", "other_hashes", "other_weights", "other_weight")
    both = rough.join(own.withColumnRenamed("node", "a"), "a").join(other, "b")
    checked = both.mapInArrow(_similar, "a long, b long, similarity double")
    return written(checked.filter(F.col("similarity") >= threshold - TINY).select("a", "b"), "links")


def similar_texts(docs: DataFrame, text: str, threshold: float, size: int, bands: int, rows: int) -> DataFrame:
    """(node, component) of the texts (by digest) that have a similar one; text must not
    be NULL."""
    spark = docs.sparkSession
    narrow = docs.select(F.xxhash64(text).alias("node"), F.col(text).alias("text"))
    n_docs, n_bytes = docs.select(F.count(F.lit(1)), F.sum(F.octet_length(text))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (n_bytes or 0) // GROUP_BYTES)
    entries = narrow.mapInArrow(_entries(parts, size), "part int, blob binary")
    counted = entries.groupBy("part").applyInPandas(_count(parts), "home int, blob binary")
    home = F.when(F.col("home") < 0, -1 - F.col("home")).otherwise(F.col("home"))
    found = counted.groupBy(home.alias("to")).applyInPandas(
        _sketch(n_docs, threshold, bands, rows),
        "node long, weight double, hashes binary, weights binary, bands array<long>, code binary, load binary",
    )
    sketches = written(found, "sketches")
    members = written(sketches.select("node", "weight", "code", F.posexplode("bands").alias("no", "band")), "members")
    leaders = members.groupBy("band").agg(F.min("node").alias("b"), F.min_by("weight", "node").alias("v"))
    # Similar texts have similar weights.
    alike = F.least("weight", "v") >= (threshold - TINY) * F.greatest("weight", "v")
    pairs = members.join(leaders, "band").filter("node <> b").filter(alike)
    pairs = pairs.select(F.col("b").alias("a"), F.col("node").alias("b")).distinct()
    pairs = written(pairs, "pairs")
    links = _links(pairs, sketches, threshold)
    labels, tried = components(links), pairs
    for best in (True, False):
        across = written(_cross_pairs(members, sketches, labels, threshold, best), "pairs")
        more = _links(across.join(tried, ["a", "b"], "left_anti"), sketches, threshold)
        tried = tried.union(across)
        if more.limit(1).count():
            links = links.union(more)
            labels = components(links)
    return labels


def classes(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    size: int = SIZE,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """(doc_id, digest, class_id, lead): the row with the smallest (doc_id, digest) leads.

    digest is the MD5 of the text and lead that of the leading row.
    """
    own = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    linked = similar_texts(own, "text", threshold, size, bands, rows)
    nodes = own.select("doc_id", F.xxhash64("text").alias("node"), F.md5("text").alias("digest"))
    labelled = nodes.join(linked, "node", "left").select(
        "doc_id", "digest", F.coalesce(F.col("component").cast("string"), F.col("digest")).alias("label")
    )
    labelled = written(labelled, "classes")
    leader = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest"))
    leaders = labelled.groupBy("label").agg(leader.alias("first"))
    leaders = leaders.select("label", F.col("first.doc_id").alias("class_id"), F.col("first.digest").alias("lead"))
    return labelled.join(leaders, "label").drop("label")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """(doc_id, class_id): class_id is the smallest doc_id of the class; one row per row.

    Equal texts are one class at once; a NULL text counts as empty, and equal texts
    without a word are one class too. A NULL doc_id sorts after all others and gives a
    NULL class only where no row of the class has an id. Texts of fewer words than a
    shingle have one shingle of all their words. An empty table gives no rows.
    """
    return classes(docs, doc_id, text, **settings).select("doc_id", "class_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The leading row of each class, all columns unchanged; of equal rows one stays."""
    found = classes(docs, doc_id, text, **settings)
    lead = found.filter(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("lead")))
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    lead = lead.select(name(F.col("doc_id")).alias("_dedup_id"), F.col("digest").alias("_dedup_text")).distinct()
    packed = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("_dedup_row"),
        name(docs[doc_id]).alias("_dedup_id"),
        F.md5(F.coalesce(docs[text], F.lit(""))).alias("_dedup_text"),
    )
    first = packed.join(lead, ["_dedup_id", "_dedup_text"], "left_semi").dropDuplicates(["_dedup_id", "_dedup_text"])
    return first.select("_dedup_row.*")
