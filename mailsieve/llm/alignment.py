"""Tokens of two tokenizers laid over each other.

Every text is encoded by a byte-level BPE (side A) and by a piece model with byte fallback
(side B); A reads a space before the text, which B adds itself. Both sides then cover the
same bytes. An as-of merge per batch, keyed by document, gives the token of the other side
that covers each token's start; the merges of both directions together are all overlaps.
Offsets where tokens of both sides end cut a document into groups.

Linked tokens end together, so the bytes of one are the end of the other's: a token of n
bytes has at most n such partners of different bytes. The table of linked id pairs is thus
bounded by the two vocabularies (the sum of all entries' lengths, times the few entries of
equal bytes), however large the corpus, and may go to every task.

Each text is encoded once, in place; a text never crosses an exchange. What is written
between the two passes is the linked id pairs of each document with their numbers.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from mailsieve.llm.common import shipped
from mailsieve.llm.tokens import pieces
from mailsieve.session import written

# How the byte-level vocabulary parts a text before merging, and the
# characters in which its entries write the bytes that are not printable.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

PIECE = 1 << 20
SPACE_MARK = "\u2581"


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for."""
    rest = [b for b in range(256) if b not in set(PRINTED)]
    return {chr(b): b for b in PRINTED} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Pair:
    """Two tokenizers, as the contents of their files; they are opened once a process."""

    json_file: bytes
    model_file: bytes
    opened: tuple = field(default=None, repr=False)

    def __getstate__(self):
        return {"json_file": self.json_file, "model_file": self.model_file, "opened": None}

    def tools(self):
        """encoder A, bytes of its ids, encoder B, bytes of its ids."""
        if self.opened is None:
            import sentencepiece
            import tiktoken

            parsed = json.loads(self.json_file)
            special = {t["content"] for t in parsed["added_tokens"]}
            chars = byte_of()
            vocab = parsed["model"]["vocab"]
            merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in parsed["model"]["merges"]]
            if merged != sorted(merged):
                raise ValueError("ids of the byte-level file do not follow the order of its merges")
            ranks = {bytes(chars[c] for c in s): i for s, i in vocab.items() if s not in special}
            a = tiktoken.Encoding("aligned", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            a_bytes = [b""] * (max(ranks.values()) + 1)
            for s, i in ranks.items():
                a_bytes[i] = s
            b = sentencepiece.SentencePieceProcessor(model_proto=self.model_file)
            b_bytes = []
            for i in range(b.get_piece_size()):
                s = b.id_to_piece(i)
                b_bytes.append(bytes([int(s[3:5], 16)]) if b.is_byte(i) else s.replace(SPACE_MARK, " ").encode())
            self.opened = a, a_bytes, b, b_bytes
        return self.opened

    @property
    def width(self) -> int:
        """Ids of side B lie below it."""
        return len(self.tools()[3])

    def bound(self) -> int:
        """Most id pairs whose tokens can end together."""
        _, a_bytes, _, b_bytes = self.tools()

        def ends(entries, others):
            known: dict[bytes, int] = {}
            for s in others:
                known[s] = known.get(s, 0) + 1
            return sum(known.get(s[k:], 0) for s in entries for k in range(len(s)))

        return ends(a_bytes, b_bytes) + ends(b_bytes, a_bytes)


def load(json_path: str, model_path: str) -> Pair:
    """Read the two files; they are sent to the tasks with the job."""
    with open(json_path, "rb") as a, open(model_path, "rb") as b:
        return Pair(a.read(), b.read())


@dataclass
class Side:
    """Tokens of the texts of a batch in order: document, id, start and end in bytes."""

    doc: np.ndarray
    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray


def _side(found: list[list[int]], widths: np.ndarray, bases: np.ndarray) -> Side:
    counts = np.fromiter(map(len, found), np.int64, len(found))
    ids = np.fromiter(chain.from_iterable(found), np.int64, counts.sum())
    doc = np.repeat(np.arange(len(found)), counts)
    ends = np.cumsum(widths[ids])
    starts = ends - widths[ids]
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    shift = np.zeros(len(found), np.int64)
    shift[counts > 0] = starts[first[counts > 0]]
    move = (bases - shift)[doc]
    return Side(doc, ids, starts + move, ends + move)


def encode(texts: list[str | None], pair: Pair) -> tuple[Side, Side]:
    """Both sides' tokens; none for a text that is NULL, empty or not given back exactly.

    Starts and ends count from the first byte of the batch, so they ascend throughout.
    """
    a, a_bytes, b, b_bytes = pair.tools()
    left, right, sizes = [], [], []
    whole = [t or "" for t in texts]
    for text, right_ids in zip(whole, b.encode(whole, num_threads=1)):
        want = (" " + text).encode()
        left_ids = a.encode_ordinary(" " + text) if text else []
        same = text and b"".join([a_bytes[i] for i in left_ids]) == want and b"".join([b_bytes[i] for i in right_ids]) == want
        left.append(left_ids if same else [])
        right.append(right_ids if same else [])
        sizes.append(len(want) if same else 0)
    bases = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
    widths = [np.fromiter(map(len, x), np.int64, len(x)) for x in (a_bytes, b_bytes)]
    return _side(left, widths[0], bases), _side(right, widths[1], bases)


def _covering(one: Side, other: Side) -> np.ndarray:
    """For each token of one, the number of the other side's token that covers its start."""
    left = pd.DataFrame({"start": one.start, "doc": one.doc})
    right = pd.DataFrame({"start": other.start, "doc": other.doc, "at": np.arange(len(other.ids))})
    return pd.merge_asof(left, right, on="start", by="doc")["at"].to_numpy()


def overlaps(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the A and B tokens that share a byte, ordered by A, then B."""
    if not len(a.ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    in_b, in_a = _covering(a, b), _covering(b, a)
    # A token's start inside a B token, or a B token's start inside an A token. Where both
    # start together the pair is met twice, so those are left out of the second half.
    late = a.start[in_a] != b.start
    left = np.concatenate([np.arange(len(a.ids)), in_a[late]])
    right = np.concatenate([in_b, np.arange(len(b.ids))[late]])
    order = np.lexsort((right, left))
    return left[order], right[order]


def _groups(a: Side, b: Side, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which overlaps end together, and per token whether it is the last of its group."""
    together = a.end[left] == b.end[right]
    last_a, last_b = np.zeros(len(a.ids), bool), np.zeros(len(b.ids), bool)
    last_a[left[together]] = True
    last_b[right[together]] = True
    return together, last_a, last_b


def _written_groups(a: Side, b: Side, last_a: np.ndarray, last_b: np.ndarray, n_docs: int) -> list[str]:
    """Per document its groups as a1,a2|b1;a3|b2,b3."""
    group_a = np.cumsum(last_a) - last_a
    group_b = np.cumsum(last_b) - last_b
    ids = np.concatenate([a.ids, b.ids])
    side = np.concatenate([np.zeros(len(a.ids), np.int8), np.ones(len(b.ids), np.int8)])
    order = np.lexsort((side, np.concatenate([group_a, group_b])))
    stop = np.concatenate([last_a, last_b])[order]
    doc = np.concatenate([a.doc, b.doc])[order]
    # After a token: a comma inside a group's side, a bar after side A, a semicolon after B.
    mark = np.where(stop, np.where(side[order] == 0, 1, 2), 0)
    marks = (",", "|", ";")
    parts = [f"{i}{marks[m]}" for i, m in zip(ids[order].tolist(), mark.tolist())]
    cut = np.searchsorted(doc, np.arange(n_docs + 1)).tolist()
    return ["".join(parts[i:j])[:-1] for i, j in zip(cut, cut[1:])]


def align(docs: DataFrame, pair: Pair, doc_id: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """One row per row of docs, from its id and text alone:

    doc_id, n_a, n_b, n_groups, n_overlaps, groups_sha256, pairs and times: the distinct id
    pairs that end together as a_id * width of B + b_id, ascending, and how often each does.
    whole adds groups (the text that is hashed), a_ids, a_ends, b_ids and b_ends (byte
    offsets in space and text), and over_a, over_b: the token numbers of each overlap.

    A text that is NULL, empty, or that a side does not give back byte by byte has no
    tokens: numbers are 0, groups_sha256 is '', arrays are empty. Equal texts have equal
    results; rows with repeated or NULL ids stay rows of their own.
    """
    held = shipped(docs.sparkSession, pair)
    named = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                yield _aligned(piece, held(), whole)

    numbers = "n_a long, n_b long, n_groups long, n_overlaps long, groups_sha256 string, pairs array<int>, times array<int>"
    more = ", groups string, a_ids array<int>, a_ends array<long>, b_ids array<int>, b_ends array<long>, over_a array<int>, over_b array<int>"
    schema = StructType([StructField("doc_id", named.schema["doc_id"].dataType)])
    for part in StructType.fromDDL(numbers + (more if whole else "")):
        schema = schema.add(part)
    return named.mapInArrow(run, schema)


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _aligned(piece: pa.RecordBatch, pair: Pair, whole: bool) -> pa.RecordBatch:
    n = len(piece)
    a, b = encode(piece.column("text").to_pylist(), pair)
    left, right = overlaps(a, b)
    together, last_a, last_b = _groups(a, b, left, right)
    texts = _written_groups(a, b, last_a, last_b, n)
    per = lambda doc: np.bincount(doc, minlength=n)[:n]
    doc = a.doc[left]
    codes = a.ids[left[together]] * pair.width + b.ids[right[together]]
    # Codes lie below 2^31, documents of a piece below 2^31.
    keys, times = np.unique(doc[together] << 31 | codes, return_counts=True)
    of = keys >> 31
    columns = {
        "doc_id": piece.column("doc_id"),
        "n_a": pa.array(per(a.doc)), "n_b": pa.array(per(b.doc)), "n_groups": pa.array(per(a.doc[last_a])), "n_overlaps": pa.array(per(doc)),
        "groups_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts], pa.string()),
        "pairs": _lists(keys & ((1 << 31) - 1), per(of), pa.int32()), "times": _lists(times, per(of), pa.int32()),
    }
    if whole:
        bases = np.zeros(n, np.int64)
        firsts = [np.searchsorted(x.doc, np.arange(n)) for x in (a, b)]
        full = per(a.doc) > 0
        bases[full] = a.start[firsts[0][full]]
        columns |= {
            "groups": pa.array(texts, pa.string()),
            "a_ids": _lists(a.ids, per(a.doc), pa.int32()), "a_ends": _lists(a.end - bases[a.doc], per(a.doc), pa.int64()),
            "b_ids": _lists(b.ids, per(b.doc), pa.int32()), "b_ends": _lists(b.end - bases[b.doc], per(b.doc), pa.int64()),
            "over_a": _lists(left - firsts[0][doc], per(doc), pa.int32()), "over_b": _lists(right - firsts[1][doc], per(doc), pa.int32()),
        }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair and n: how many links of the whole corpus hold it. Sums combine per batch,
    then per task, before they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("pairs").flatten().to_numpy(zero_copy_only=False)
            if len(codes):
                keys, at = np.unique(codes, return_inverse=True)
                n = np.bincount(at, weights=batch.column("times").flatten().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(n.astype(np.int64))], names=["pair", "n"])

    return aligned.select("pairs", "times").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


@dataclass
class Counts:
    """Linked id pairs, ascending, how often each is linked, and which is its B id's best."""

    pairs: np.ndarray
    n: np.ndarray
    best: np.ndarray


def counted(aligned: DataFrame, pair: Pair) -> Counts:
    """The pair table; its size is bounded by the vocabularies (see Pair.bound)."""
    table = pair_counts(aligned).toArrow()
    codes, n = (table.column(c).to_numpy() for c in ("pair", "n"))
    order = np.argsort(codes)
    codes, n = codes[order].astype(np.int64), n[order].astype(np.int64)
    most = np.zeros(pair.width, np.int64)
    np.maximum.at(most, codes % pair.width, n)
    return Counts(codes, n, n == most[codes % pair.width])


def linked(docs: DataFrame, pair: Pair, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, n_overlaps, groups_sha256.

    A link is an A and a B token that end together; its count is how many links of the
    whole table hold its id pair. n_best are the links whose count is the highest of their
    B id, ties included, and count_sum adds the counts of all links. Rows without tokens
    have zeros and ''; an empty table gives no rows.
    """
    aligned = written(align(docs, pair, doc_id, text), "aligned")
    held = shipped(docs.sparkSession, counted(aligned, pair))
    kind = aligned.schema["doc_id"].dataType
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "n_overlaps", "groups_sha256"]
    schema = StructType([StructField(c, kind if c == "doc_id" else StringType() if c == "groups_sha256" else LongType()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("pairs")
            codes = lists.flatten().to_numpy(zero_copy_only=False)
            times = batch.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            at = np.searchsorted(held().pairs, codes)
            upto = np.concatenate([[0], np.cumsum(lengths)])
            found = {"n_links": times, "n_best": np.where(held().best[at], times, 0), "count_sum": times * held().n[at]}
            for c, v in found.items():
                sums = np.concatenate([[0], np.cumsum(v)])
                found[c] = pa.array(sums[upto[1:]] - sums[upto[:-1]], pa.int64())
            yield pa.RecordBatch.from_arrays([found[c] if c in found else batch.column(c) for c in names], names=names)

    return aligned.mapInArrow(run, schema)
