"""SentencePiece encoding and decoding of whole texts.

The lattice of a text: every substring of bounded length that is a piece is an edge. Two
neighbouring characters that no piece holds side by side part the text into words that
cannot influence each other, so each distinct word of a piece of input is solved once:

1. substrings of growing length of all words are looked up in the piece table, which is
   the size of the vocabulary file and what every task gets; a substring that starts no
   piece is not extended;
2. edges are grouped by word;
3. the words are folded together, one merge per word and round: the best-ranked edge that
   joins two neighbouring symbols, leftmost on ties, until none is left.

The file's pieces are ranked merges (BPE). A best path (Viterbi) over their scores gives
other ids than the tokenizer that the file belongs to, hence the fold by rank. Characters
without a piece become bytes. Texts are encoded where they are: nothing is shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from mailsieve.llm import tokens
from mailsieve.llm.common import shipped
from mailsieve.llm.minhash import runs

SPACE = 0x2581
NORMAL, BYTE = 1, 6
BPE = 2
PIECE_BYTES = 1 << 20
BIGRAM_BITS = 22
LONG = 256
NONE = np.int32(np.iinfo(np.int32).max)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _bigram(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.uint64) * MULTIPLIER + b.astype(np.uint64)) * MULTIPLIER) >> np.uint64(64 - BIGRAM_BITS)


@dataclass
class Pieces:
    """Piece table. keys hashes every prefix of a piece (open addressing, 0 is empty); its
    rank, NONE for a mere prefix, stands at the same slot."""

    keys: np.ndarray
    rank: np.ndarray
    id_of_rank: np.ndarray
    shift: int
    joined: np.ndarray
    longest: int
    of_byte: np.ndarray
    surface: list[bytes]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 where there is none."""
        slot = (hashes >> np.uint64(self.shift)).astype(np.int64)
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        while len(left):
            key = self.keys[slot]
            hit = key == hashes[left]
            out[left[hit]] = slot[hit]
            go = ~hit & (key != 0)
            left, slot = left[go], (slot[go] + 1) & (len(self.keys) - 1)
        return out


def _step(prefix, char):
    """Hash of a string from that of the string less its last character."""
    return tokens.mix((prefix + np.uint64(1)) * MULTIPLIER + np.asarray(char, np.uint64))


def make_pieces(entries: list[tuple[str, float, int, int]]) -> Pieces:
    """Table from (piece, score, kind, id); better scores merge first."""
    normal = sorted(((p, s, i) for p, s, kind, i in entries if kind == NORMAL), key=lambda x: -x[1])
    rank = {p: r for r, (p, _, _) in enumerate(normal)}
    ids = {p: i for p, _, i in normal}
    hashes: dict[str, int] = {"": 0}
    with np.errstate(over="ignore"):
        for p in ids:
            for n in range(1, len(p) + 1):
                if p[:n] not in hashes:
                    hashes[p[:n]] = int(_step(np.array([hashes[p[: n - 1]]], np.uint64), np.array([ord(p[n - 1])], np.uint64))[0])
    del hashes[""]
    bits = max(4, int(np.ceil(np.log2(4 * len(hashes) + 1))))
    keys, ranks = np.zeros(1 << bits, np.uint64), np.full(1 << bits, NONE, np.int32)
    for p, h in hashes.items():
        slot = h >> (64 - bits)
        while keys[slot]:
            slot = (slot + 1) & ((1 << bits) - 1)
        keys[slot] = h
        if p in ids:
            ranks[slot] = rank[p]
    pairs = np.array([(ord(a), ord(b)) for p in ids for a, b in zip(p, p[1:])] or [(0, 0)], np.uint32)
    joined = np.zeros(1 << BIGRAM_BITS, bool)
    joined[_bigram(pairs[:, 0], pairs[:, 1])] = True
    of_byte = np.full(256, -1, np.int32)
    surface = [b""] * (1 + max(i for *_, i in entries))
    for p, _, kind, i in entries:
        if kind == BYTE:
            of_byte[int(p[3:5], 16)] = i
            surface[i] = bytes([int(p[3:5], 16)])
        elif kind == NORMAL:
            surface[i] = p.replace(chr(SPACE), " ").encode()
    if (of_byte < 0).any():
        raise ValueError("the piece table has no bytes to fall back on")
    id_of_rank = np.array([i for _, _, i in normal], np.int32)
    return Pieces(keys, ranks, id_of_rank, 64 - bits, joined, max(map(len, ids)), of_byte, surface)


def load(path: str) -> Pieces:
    """Piece table of a model file of ranked merges without text normalisation."""
    from sentencepiece import sentencepiece_model_pb2 as model

    proto = model.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    rules = proto.normalizer_spec
    if proto.trainer_spec.model_type != BPE or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix:
        raise ValueError(f"{path}: only BPE models that keep the text as it is and put a space before it")
    return make_pieces([(p.piece, p.score, p.type, i) for i, p in enumerate(proto.pieces)])


def _spread(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Positions of several ranges, one after the other."""
    total = int(n.sum())
    return np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n).astype(np.int64) + np.arange(total) if total else np.zeros(0, np.int64)


class Lattice:
    """Edges of many words: rank of the piece of each length at each character."""

    def __init__(self, chars: np.ndarray, starts: np.ndarray, n: np.ndarray, pieces: Pieces):
        self.chars, self.starts, self.n = chars, starts, n
        left = np.repeat(starts + n, n) - np.arange(len(chars))
        longest = min(pieces.longest, int(n.max(initial=1)))
        self.rank = np.full((longest + 1, len(chars)), NONE, np.int32)
        at, prefix = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        for size in range(1, longest + 1):
            prefix = _step(prefix, chars[at + size - 1])
            slot = pieces.find(prefix)
            known = slot >= 0
            at, prefix, slot = at[known], prefix[known], slot[known]
            self.rank[size, at] = pieces.rank[slot]
            more = left[at] > size
            at, prefix = at[more], prefix[more]

    def merge(self) -> np.ndarray:
        """Length of the symbol that starts at each character, 0 inside a symbol."""
        length = np.ones(len(self.chars), np.int64)
        short = self.n <= LONG
        for start, n in zip(self.starts[~short], self.n[~short]):
            self._merge_long(length, int(start), int(n))
        at = _spread(self.starts[short], self.n[short])
        word = np.repeat(np.arange(short.sum()), self.n[short])
        top = len(self.rank) - 1
        while len(at):
            size = length[at]
            pair = np.zeros(len(at), np.int64)
            pair[:-1] = np.where(word[1:] == word[:-1], size[:-1] + size[1:], 0)
            fits = (pair > 0) & (pair <= top)
            rank = np.where(fits, self.rank[np.where(fits, pair, 0), at], NONE)
            begins = runs(word)
            # The smallest rank of a word, leftmost on ties.
            order = (rank.astype(np.int64) << 32) | np.arange(len(at))
            best = np.minimum.reduceat(order, begins)
            go = (best >> 32) < NONE
            first = (best & 0xFFFFFFFF)[go]
            length[at[first]] = pair[first]
            length[at[first + 1]] = 0
            n = np.diff(np.append(begins, len(at)))
            keep = np.repeat(go, n)
            keep[first + 1] = False
            at, word = at[keep], word[keep]
        return length

    def _merge_long(self, length: np.ndarray, start: int, n: int) -> None:
        """The same for one long word, with a queue of pairs."""
        top = len(self.rank) - 1
        before = {start + i: start + i - 1 for i in range(1, n)}
        queue: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = i + int(length[i])
            if j < start + n:
                size = j - i + int(length[j])
                if size <= top and self.rank[size, i] != NONE:
                    heapq.heappush(queue, (int(self.rank[size, i]), i, size))

        for i in range(start, start + n):
            offer(i)
        while queue:
            _, i, size = heapq.heappop(queue)
            j = i + int(length[i])
            if not length[i] or j >= start + n or int(length[i] + length[j]) != size:
                continue
            length[j], length[i] = 0, size
            if i + size < start + n:
                before[i + size] = i
            offer(i)
            if i in before:
                offer(before[i])


def encode_texts(texts: list[str | None], pieces: Pieces) -> pa.ListArray:
    """Piece ids of each text; NULL stays NULL, an empty text has none."""
    whole = "".join(" " + t for t in texts if t)
    chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    chars = np.where(chars == 0x20, np.uint32(SPACE), chars)
    sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    ends = np.cumsum(sizes)
    cut = np.ones(len(chars) + 1, bool)
    cut[1:-1] = ~pieces.joined[_bigram(chars[:-1], chars[1:])]
    cut[ends] = True
    starts = np.flatnonzero(cut[:-1])
    n = np.diff(np.append(starts, len(chars)))
    # Words by hash: each distinct one is solved once.
    ids, counts = np.zeros(0, np.int32), np.zeros(0, np.int64)
    if len(starts):
        _, first, word = np.unique(_word_hashes(chars, starts, n), return_index=True, return_inverse=True)
        at = _spread(starts[first], n[first])
        own = np.concatenate([[0], np.cumsum(n[first])[:-1]]).astype(np.int64)
        found, per_word = _solve(chars[at], own, n[first], pieces)
        begin = np.concatenate([[0], np.cumsum(per_word)[:-1]]).astype(np.int64)
        counts = per_word[word]
        ids = found[_spread(begin[word], counts)]
    upto = np.concatenate([[0], np.cumsum(counts)])
    offsets = upto[np.searchsorted(starts, np.concatenate([[0], ends]))]
    missing = np.array([t is None for t in texts] + [False])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), mask=missing), pa.array(ids))


def _word_hashes(chars: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hash per word: the sum of its characters' hashes, each with its place and the length."""
    place = np.arange(len(chars)) - np.repeat(starts, n)
    return np.add.reduceat(tokens.mix((chars.astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64)), starts) + tokens.mix(n)


def _solve(chars: np.ndarray, starts: np.ndarray, n: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in order, and how many each has."""
    lattice = Lattice(chars, starts, n, pieces)
    length = lattice.merge()
    at = np.flatnonzero(length)
    rank = lattice.rank[length[at], at]
    ids = np.where(rank < NONE, pieces.id_of_rank[np.where(rank < NONE, rank, 0)], -1)
    word = np.searchsorted(starts, at, "right") - 1
    unknown = np.flatnonzero(ids < 0)
    if len(unknown):
        raw = [chr(c).encode() for c in chars[at[unknown]]]
        times = np.ones(len(at), np.int64)
        times[unknown] = [len(b) for b in raw]
        where = np.repeat(ids < 0, times)
        ids, word = np.repeat(ids, times), np.repeat(word, times)
        ids[where] = pieces.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
    return ids.astype(np.int32), np.bincount(word, minlength=len(starts))


def decode_ids(ids: pa.ListArray, pieces: Pieces, joined: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Texts of lists of ids, less the space put before each; joined and ends are the
    surfaces of all pieces and where each stops."""
    lists = ids.cast(pa.large_list(pa.int32()))
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    begins = np.concatenate([[0], ends[:-1]])
    n = (ends - begins)[values]
    data = joined[_spread(begins[values], n)]
    upto = np.concatenate([[0], np.cumsum(n)])[offsets - offsets[0]]
    space = np.zeros(len(data), bool)
    full = upto[:-1][np.diff(upto) > 0]
    space[full] = data[full] == 0x20
    removed = np.concatenate([[0], np.cumsum(space)])
    where = upto - removed[upto]
    data = data[~space]
    empty = np.array(ids.is_null()) if ids.null_count else np.zeros(len(ids), bool)
    out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(where.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
    texts = [None if e else x.decode("utf-8", "replace") for x, e in zip(out.to_pylist(), empty)]
    return pa.array(texts, pa.string())


def surfaces(pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(pieces.surface), np.uint8), np.cumsum([len(s) for s in pieces.surface])


def encode(
    docs: DataFrame, pieces: Pieces, text: str = "text", name: str = "piece_ids", decoded: str | None = None
) -> DataFrame:
    """docs with an array of piece ids added (or replaced) under name.

    A NULL text gives NULL, an empty one no ids. A text is taken as it is, with a space
    put before it; U+2581, which stands for the space, is read as one. With decoded, the
    text that the ids decode to is added under that name in the same pass.
    """
    table = shipped(docs.sparkSession, pieces)
    kept = [c for c in docs.columns if c not in (name, decoded) or c == text]
    packed = docs.select(*kept)
    place = kept.index(text)
    own = [c for c in kept if c != decoded]
    fields = [f for f in packed.schema.fields if f.name != decoded] + [T.StructField(name, T.ArrayType(T.IntegerType()))]
    fields += [T.StructField(decoded, T.StringType())] if decoded else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, ends = surfaces(table())
        for batch in batches:
            for part in tokens.pieces(batch, text, PIECE_BYTES):
                new = [encode_texts(part.column(place).to_pylist(), table())]
                if decoded:
                    new.append(decode_ids(new[0], table(), joined, ends))
                yield pa.RecordBatch.from_arrays([*[part.column(kept.index(c)) for c in own], *new], names=[f.name for f in fields])

    return packed.mapInArrow(run, T.StructType(fields))


def decode(rows: DataFrame, pieces: Pieces, ids: str = "piece_ids", name: str = "decoded") -> DataFrame:
    """rows with the text of their ids added (or replaced) under name; NULL gives NULL.

    Bytes that form no character become U+FFFD; control ids have no text.
    """
    table = shipped(rows.sparkSession, pieces)
    kept = [c for c in rows.columns if c != name]
    packed = rows.select(*kept)
    place = kept.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, ends = surfaces(table())
        for batch in batches:
            for first in range(0, len(batch), 500):
                part = batch.slice(first, 500)
                texts = decode_ids(part.column(place), table(), joined, ends)
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*kept, name])

    return packed.mapInArrow(run, T.StructType([*packed.schema.fields, T.StructField(name, T.StringType())]))
