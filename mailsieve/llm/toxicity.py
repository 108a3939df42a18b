"""Toxicity of a text by logistic regression on hashed n-grams, learned with FTRL-proximal.

Features are the words of a text, its pairs of neighbours, its skip-grams (pairs with one
word between) and its words cut to their first letters, hashed into 2^BITS places. A
feature's value is the damped number of its occurrences, scaled to one length for all
texts. FTRL-proximal keeps two sums per place (z and the squared gradients n), so each
place has its own learning rate and L1 leaves most weights at zero; what goes to the tasks
that score is the short list of weights that are not.

Learning looks at about max_docs labelled rows (a parameter), chosen by digest. They are
cut into blocks; each round passes every block once, in parallel, from the shared sums, and
the blocks' sums are averaged by their rows in an aggregation. Sums are arrays of 2^BITS
places, whatever the number of rows. Scoring reads every whole text in place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.common import shipped
from mailsieve.llm.tokens import BASE, Words, _hashes, mix, pieces, words
from mailsieve.session import written

BITS = 18
STEMS = (4, 6)
SCALE = 20.0
THRESHOLD = 0.3
MAX_DOCS = 12_000
BLOCK_DOCS = 1_000
BLOCK_FEATURES = 4_000_000
PIECE = 1 << 20
#: Words looked at together within one text; the places are counted block by block.
SPAN = 1 << 17


@dataclass(frozen=True)
class Settings:
    """alpha and beta set the rates, l1 the sparsity, l2 the shrinkage."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 2.0
    l2: float = 1.0
    rounds: int = 6


@dataclass
class Model:
    """Places with a weight, ascending, their weights, and the bias (None: nothing learned)."""

    places: np.ndarray
    weights: np.ndarray
    bias: float | None

    def dense(self) -> np.ndarray:
        full = np.zeros(1 << BITS)
        full[self.places] = self.weights
        return full


def plain(text: Column) -> Column:
    """Lower case, with everything but letters, marks and digits as spaces."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " ")


def held_out(doc_id: Column) -> Column:
    """The quarter of the ids that no model may learn from; a NULL id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _cut(w: Words, chars: int) -> np.ndarray:
    """Where each word's first so many characters end."""
    starts_char = np.concatenate([(w.data & 0xC0) != 0x80, [True]])
    places = np.flatnonzero(starts_char)
    first = np.searchsorted(places, w.starts)
    return np.minimum(places[np.minimum(first + chars, len(places) - 1)], w.ends)


def _hashed(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Place and text of every feature occurrence."""
    text = w.text
    found, of = [w.hashes], [text]
    for step in (1, 2):
        same = text[step:] == text[:-step]
        found.append(mix(w.hashes[:-step] * np.uint64(BASE) + w.hashes[step:] + np.uint64(step))[same])
        of.append(text[step:][same])
    for chars in STEMS:
        found.append(mix(_hashes(w.data, w.starts, _cut(w, chars)) + np.uint64(100 + chars)))
        of.append(text)
    return (np.concatenate(found) & np.uint64((1 << BITS) - 1)).astype(np.int64), np.concatenate(of)


def _long(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of one text, span by span; memory follows the places, not the text."""
    total = np.zeros(1 << BITS, np.int64)
    for i in range(0, len(w.starts), SPAN):
        first = max(0, i - 2)
        part = lambda a, b: Words(w.data, np.array([0, len(w.data)]), w.starts[a:b], w.ends[a:b], w.hashes[a:b])
        total += np.bincount(_hashed(part(first, i + SPAN))[0], minlength=1 << BITS)
        if first < i:  # the two words before the span were counted with the span before
            total -= np.bincount(_hashed(part(first, i))[0], minlength=1 << BITS)
    places = np.flatnonzero(total)
    return places, total[places]


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place and number of occurrences, ordered by text and place."""
    w = words(column)
    if len(column) == 1 and len(w.starts) > SPAN:
        places, counts = _long(w)
        return np.zeros(len(places), np.int64), places, counts
    places, text = _hashed(w)
    keys, counts = np.unique(text << BITS | places, return_counts=True)
    return keys >> BITS, keys & ((1 << BITS) - 1), counts


def values(text: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Damped counts, scaled to one length per text."""
    v = 1 + np.log(counts)
    length = np.sqrt(np.bincount(text, weights=v * v, minlength=n))
    return SCALE * v / length[text]


def weights_of(z: np.ndarray, n: np.ndarray, s: Settings, l1: float) -> np.ndarray:
    """The weights that the sums stand for: zero up to l1, beyond it by the place's rate."""
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))


def learn(rows: list[tuple[int, np.ndarray, np.ndarray]], z: np.ndarray, n: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The sums after one pass over rows of (label, places, values); the last place is the
    bias, which has value 1 in every row and no L1."""
    z, n = z.copy(), n.copy()
    bias = len(z) - 1
    for label, places, x in rows:
        w = weights_of(z[places], n[places], s, s.l1)
        b = float(weights_of(z[bias:], n[bias:], s, 0.0)[0])
        p = 1 / (1 + np.exp(-np.clip(w @ x + b, -35, 35)))
        for at, g, held in ((places, (p - label) * x, w), (bias, p - label, b)):
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
            z[at] += g - step * held
            n[at] += g * g
    return z, n


def chosen(labels: DataFrame, doc_id: str, label: str, max_docs: int) -> DataFrame:
    """id and label (1 if any row says so) of about max_docs ids, by digest; ids or labels
    that are NULL are left out."""
    rows = labels.select(labels[doc_id].alias("id"), labels[label].cast("int").alias("label")).filter("id IS NOT NULL AND label IS NOT NULL")
    rows = rows.groupBy("id").agg(F.max((F.col("label") > 0).cast("int")).alias("label"))
    n = rows.count()
    u = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30))
    return rows.filter(u < int((1 << 30) * max_docs / n)) if n > max_docs else rows


def blocks(rows: DataFrame, max_docs: int) -> DataFrame:
    """One row per block of training rows: labels, where each row's features begin, places
    and counts. rows has id, label and text; rows alike in all three teach once."""
    rows = rows.dropDuplicates(["id", "label", "text"]).withColumn("digest", F.xxhash64("id", "label", "text"))
    rows = written(rows, "labelled")
    # One id may have very many texts, so the bound holds for rows as well as for ids.
    n = rows.count()
    if n > 2 * max_docs:
        rows = rows.filter(F.pmod("digest", F.lit(1 << 30)) < int((1 << 30) * max_docs / n))
    shards = max(1, -(-min(n, max_docs) // BLOCK_DOCS))
    rows = rows.withColumn("shard", F.pmod(F.hash("digest"), F.lit(shards)).cast("int"))
    rows = rows.repartition(shards, "shard").sortWithinPartitions("shard", "digest", "id", "label")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, labels, starts, places, counts = -1, [], [], [], []

        def out():
            flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (places, counts)]
            kinds = (("labels", labels, pa.int32()), ("starts", starts, pa.int32()), ("places", flat[0], pa.int32()), ("counts", flat[1], pa.int32()))
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), *[pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, kind)) for _, v, kind in kinds]],
                names=["shard", *[c for c, _, _ in kinds]],
            )

        held = 0
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                text, at, times = features(piece.column("text"))
                cut = np.searchsorted(text, np.arange(len(piece) + 1))
                for i, (own, label) in enumerate(zip(piece.column("shard").to_pylist(), piece.column("label").to_pylist())):
                    if labels and (own != shard or len(labels) >= BLOCK_DOCS or held >= BLOCK_FEATURES):
                        yield out()
                        labels, starts, places, counts, held = [], [], [], [], 0
                    shard = own
                    labels.append(label)
                    starts.append(held)
                    places.append(at[cut[i] : cut[i + 1]])
                    counts.append(times[cut[i] : cut[i + 1]])
                    held += int(cut[i + 1] - cut[i])
        if labels:
            yield out()

    ddl = "shard int, labels array<int>, starts array<int>, places array<int>, counts array<int>"
    return written(rows.select("shard", "label", plain(F.col("text")).alias("text")).mapInArrow(pack, ddl), "blocks")


def _pass(packed: DataFrame, z: np.ndarray, n: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, int]:
    """One round: every block learns from the same sums, which are then averaged by rows."""
    held = shipped(packed.sparkSession, (z, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                labels, starts, places, counts = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("labels", "starts", "places", "counts"))
                cut = [*starts.tolist(), len(places)]
                rows = [(int(y), places[a:b], values(np.zeros(b - a, np.int64), counts[a:b], 1)) for y, a, b in zip(labels, cut, cut[1:])]
                after = learn(rows, *held(), s)
                moved = np.flatnonzero((after[0] != held()[0]) | (after[1] != held()[1]))
                moves = [pa.array((x[moved] - old[moved]) * len(rows)) for x, old in zip(after, held())]
                yield pa.RecordBatch.from_arrays([pa.array(moved, pa.int32()), *moves], names=["place", "z", "n"])
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([float(len(rows))]), pa.array([0.0])], names=["place", "z", "n"])

    summed = packed.mapInArrow(run, "place int, z double, n double").groupBy("place").agg(F.sum("z").alias("z"), F.sum("n").alias("n"))
    table = summed.toArrow()
    place, dz, dn = (table.column(c).to_numpy() for c in ("place", "z", "n"))
    rows = float(dz[place == -1].sum())
    z, n, moved = z.copy(), n.copy(), place >= 0
    if rows:
        z[place[moved]] += dz[moved] / rows
        n[place[moved]] += dn[moved] / rows
    return z, n, int(rows)


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    max_docs: int = MAX_DOCS, settings: Settings = Settings(),
) -> Model:
    """Model from about max_docs labelled documents, joined on the id and chosen by its digest.

    A label above 0 is toxic; an id with several labels is toxic if one of them is. NULL ids
    and labels teach nothing, a NULL text counts as an empty one. No rows: no model.
    """
    # Rows of the join's broadcast side: an id and a label of about max_docs ids.
    few = F.broadcast(chosen(labels, doc_id, label, max_docs).withColumnRenamed("id", "label_id"))
    rows = docs.select(docs[doc_id].alias("id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    packed = blocks(rows.join(few, F.col("id") == F.col("label_id")).select("id", "label", "text"), max_docs)
    z, n, seen = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1), 0
    for _ in range(settings.rounds):
        z, n, seen = _pass(packed, z, n, settings)
    w = weights_of(z[:-1], n[:-1], settings, settings.l1)
    places = np.flatnonzero(w)
    bias = float(weights_of(z[-1:], n[-1:], settings, 0.0)[0]) if seen else None
    return Model(places, w[places], bias)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, score (0 to 1) and predicted (1 from THRESHOLD on); a row per row.

    Only the text is looked at: equal texts score equally. NULL and empty texts score by the
    bias alone; without a model every score is 0. A kept column called score or predicted
    gives way to the result.
    """
    held = shipped(docs.sparkSession, model)
    keep = tuple(c for c in keep if c not in ("score", "predicted"))
    named = docs.select(*[docs[c] for c in keep], plain(docs[text]).alias("_plain"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = held().dense(), held().bias
        for batch in batches:
            for piece in pieces(batch, "_plain", PIECE):
                if bias is None:
                    score = np.zeros(len(piece))
                else:
                    of, places, counts = features(piece.column("_plain"))
                    total = np.bincount(of, weights=weights[places] * values(of, counts, len(piece)), minlength=len(piece))
                    score = 1 / (1 + np.exp(-np.clip(total + bias, -35, 35)))
                yield pa.RecordBatch.from_arrays(
                    [*[piece.column(c) for c in keep], pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                    names=[*keep, "score", "predicted"],
                )

    return named.mapInArrow(run, named.drop("_plain").schema.add("score", "double").add("predicted", "integer"))
