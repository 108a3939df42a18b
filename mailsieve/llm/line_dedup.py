"""Near-equal lines removed by an exact set-similarity join.

A line is the set of its words. It is removed if an earlier line, by (doc_id, place in the
text), has Jaccard similarity of at least the threshold with it, whether that line stays
or not.

1. How rare each word is comes from one pass over all texts into a counting table of
   fixed size; it only orders the words, so its collisions cost time, never results.
2. Each distinct line of a piece of input sends its prefix, the rarest words of which any
   similar line must hold one, to the range of each word's hash; equal lines meet in the
   range of their set's hash, which needs no join.
3. In a word's range every line is held against the earlier lines of like length that share
   the word, nearest lengths first, until one is all but certain to be similar or enough
   pass the length, position and bitmap filters; the closest of these are its candidates.
   Of two lines the shorter one must hold the word among still fewer of its rarest, so a
   word that many lines share behind rarer ones of their own joins none of them. The lines
   of a word that very many hold in their prefix (estimated from a sample, which decides
   the layout only) are dealt to chunks, and every two chunks meet in a range of their own.
4. Candidates are verified on the words themselves, the closest of each line first and the
   others only if it fails. Lines whose candidates all fail although others were left
   untried are joined with all lines that share a prefix word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.llm import tokens
from mailsieve.llm.common import lines_of, shipped, without_lines, words_of
from mailsieve.llm.minhash import pack, runs, unpack
from mailsieve.session import written

THRESHOLD = 0.8
SKETCH_BITS, SLICE = 20, 1 << 16
GROUP_BYTES = 64 << 20
NO_ID = np.iinfo(np.int64).max
# Bits of the tables that say which words or texts are looked for; an unlucky bit costs
# time. So many texts go to every task as rows; of more, the bits go.
BITS, SMALL = 26, 500_000
TINY = 1e-9
# Words of 64 bits per line; every word of the line flips one bit, so lines differ in at
# least as many words as bits. A candidate with so few differing bits, of the most allowed,
# is all but certain, and the search for others ends.
BITMAP, STRONG, SLACK = 4, 0.4, 1.5
# Candidates of a line that one word range sends on at first; step 4 has the way for the rest.
TRIED, LIKELY = 4, 0.8
# Where the closest is not likely, more of them go on; and so many candidates by one word,
# likely ones or any, end the search.
OTHERS, ENOUGH, MOST = 16, 16, 64
# Entries of one word that may meet in one group, and the part of the rows that is sampled.
HOT, SAMPLED = 1 << 21, 1 / 32

# An entry's word is the lower half of its hash; the range stands for most of the upper half,
# and words taken for one cost time only. Whether an entry begins a line stands for the line.
ENTRY = (np.uint32, np.uint16, np.uint8, np.int64, np.int64, np.uint32, np.uint32, np.uint32, np.uint64)
LINE = (np.uint64, np.uint64, np.int64, np.int64, np.uint32)
GONE = (np.int64, np.int64, np.uint32)
PLACE = ["id", "digest", "line_no"]
OTHER = ["other_id", "other_digest", "other_line_no"]
FOUND = "id long, digest long, line_no long, other_id long, other_digest long, other_line_no long, differ long, more boolean"


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, n_bytes = np.zeros(1 << SKETCH_BITS, np.uint32), 0
    for batch in batches:
        for piece in tokens.pieces(batch, "text"):
            w = tokens.words(piece.column("text"))
            slots = w.hashes >> np.uint64(64 - SKETCH_BITS)
            table += np.bincount(slots.astype(np.int64), minlength=len(table)).astype(np.uint32)
            n_bytes += len(w.data)
    if table.any():
        parts = np.split(table, len(table) // SLICE)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(len(parts)), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary()),
                pa.array([n_bytes] + [0] * (len(parts) - 1), pa.int64()),
            ],
            names=["slice", "counts", "n_bytes"],
        )


def _add(group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(SLICE, np.uint64)
    for counts in group["counts"]:
        total += np.frombuffer(counts, np.uint32)
    return pd.DataFrame({"slice": group["slice"][:1], "counts": [total.tobytes()], "n_bytes": [group["n_bytes"].sum()]})


TALLY = "slice int, counts binary, n_bytes long"


def word_ranks(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Rank (0 to 4095, rarer is smaller) per slot of the word hash, a table of fixed size;
    and the bytes of all texts."""
    rows = texts.mapInArrow(_tally, TALLY).groupBy("slice").applyInPandas(_add, TALLY)
    counts, n_bytes = np.zeros((1 << SKETCH_BITS) // SLICE * SLICE, np.uint64).reshape(-1, SLICE), 0
    for row in rows.collect():
        counts[row["slice"]] = np.frombuffer(row["counts"], np.uint64)
        n_bytes += row["n_bytes"]
    return np.minimum(np.log2(counts.ravel() + 1.0) * 100, 4095).astype(np.uint16), n_bytes


class Lines:
    """Word sets of the lines of a piece, or of those that may hold a word of a bit table:
    words in order of rarity, line by line."""

    def __init__(self, column: pa.Array, ranks: np.ndarray, threshold: float, bits: np.ndarray | None = None):
        w = tokens.words(column)
        # Lines before each word, over all texts: line feeds, and the ends of texts.
        feeds = np.flatnonzero(w.data == 0x0A)
        text, words = w.text, w.hashes
        line = np.cumsum(np.bincount(np.searchsorted(w.starts, feeds), minlength=len(words) + 1))[: len(words)] + text
        if bits is not None and len(line):
            wanted = np.zeros(line[-1] + 1, bool)
            wanted[line[in_table(bits, words)]] = True
            wanted = wanted[line]
            line, words, text = line[wanted], words[wanted], text[wanted]
        # Words stay within their line, so line and text are in order already.
        words = self._by_rarity(line, ranks[(words >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], words)
        fresh = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (words[1:] != words[:-1])])[: len(line)])
        line, self.words = line[fresh], words[fresh]
        self.starts = runs(line)
        self.n = np.diff(np.append(self.starts, len(line)))
        self.text = text[fresh[self.starts]]
        self.line_no = line[self.starts] - np.searchsorted(feeds, w.offsets[self.text]) - self.text
        self.a = np.add.reduceat(self.words, self.starts) if len(line) else words
        self.b = np.add.reduceat(tokens.mix(self.words ^ np.uint64(tokens.BASE)), self.starts) if len(line) else words
        self.bits = np.zeros((len(self.starts), BITMAP), np.uint64)
        bit, place = np.uint64(1) << (self.words & np.uint64(63)), (self.words >> np.uint64(6)) & np.uint64(BITMAP - 1)
        for k in range(BITMAP if len(line) else 0):
            self.bits[:, k] = np.bitwise_xor.reduceat(np.where(place == k, bit, np.uint64(0)), self.starts)
        self.prefix = self.n - np.ceil(threshold * self.n - TINY).astype(np.int64) + 1

    @staticmethod
    def _by_rarity(line, rank, hashes):
        """The words of each line, rarest first."""
        if len(line) and line[-1] < 1 << 20:
            key = (line.astype(np.uint64) << np.uint64(44)) | (rank.astype(np.uint64) << np.uint64(32)) | (hashes >> np.uint64(32))
            order = np.argsort(key)
            k, h = key[order], hashes[order]
            if not ((k[1:] == k[:-1]) & (h[1:] < h[:-1])).any():
                return h
        return hashes[np.lexsort((hashes, rank, line))]


def bit_table(hashes: DataFrame) -> np.ndarray:
    """Bits of a column of hashes; of one size whatever their number."""
    low = F.col(hashes.columns[0]).bitwiseAND(F.lit((1 << BITS) - 1))
    rows = hashes.select(F.shiftright(low, 6).alias("slot"), low.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    found = rows.groupBy("slot").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def in_table(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    low = hashes & np.uint64((1 << BITS) - 1)
    return (bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1)).astype(bool)


def least_words(threshold: float) -> int:
    """Shorter lines are similar to equal ones only."""
    return math.ceil(threshold / (1 - threshold) - TINY) if threshold < 1 else np.iinfo(np.int64).max


def _tally_prefixes(ranks, threshold: float):
    """Prefix entries per slot of the word hash, as _tally counts words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for piece in tokens.pieces(batch, "text"):
                x = Lines(piece.column("text"), ranks.value, threshold)
                prefix = np.where(x.n >= least_words(threshold), x.prefix, 0)
                line = np.repeat(np.arange(len(x.n)), prefix)
                pos = np.arange(len(line)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
                slots = x.words[x.starts[line] + pos] >> np.uint64(64 - SKETCH_BITS)
                table += np.bincount(slots.astype(np.int64), minlength=len(table)).astype(np.uint32)
        if table.any():
            parts = np.split(table, len(table) // SLICE)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(parts)), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary()), pa.array([0] * len(parts), pa.int64())],
                names=["slice", "counts", "n_bytes"],
            )

    return run


def hot_chunks(own: DataFrame, ranks, threshold: float) -> np.ndarray | None:
    """Chunks per slot of the word hash: 1, or more where over HOT lines seem to have a
    word of the slot in their prefix; None if no slot has."""
    # No word has more entries than occurrences.
    if 2 ** (float(ranks.value.max()) / 100 + 0.01) <= HOT:
        return None
    rows = own.select("text").sample(SAMPLED, seed=1).mapInArrow(_tally_prefixes(ranks, threshold), TALLY)
    counts = np.zeros((1 << SKETCH_BITS) // SLICE * SLICE).reshape(-1, SLICE)
    for row in rows.groupBy("slice").applyInPandas(_add, TALLY).collect():
        counts[row["slice"]] = np.frombuffer(row["counts"], np.uint64)
    counts = counts.ravel() / SAMPLED
    return np.where(counts > HOT, np.ceil(2 * counts / HOT), 1).astype(np.int64) if (counts > HOT).any() else None


def _dealt(word, line, pos, ids, digest, line_no, hot):
    """The entries, those of hot words once for every two chunks that hold theirs, under a
    word of their own."""
    if hot is None or not len(word):
        return word, line, pos
    chunks = hot[(word >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    is_hot = chunks > 1
    n = np.where(is_hot, chunks - 1, 1)
    key = tokens.mix(ids.view(np.uint64) ^ tokens.mix(digest.astype(np.uint64) ^ tokens.mix(line_no.astype(np.uint64))))[line]
    own = (key % chunks.astype(np.uint64)).astype(np.int64)
    rows = np.repeat(np.arange(len(word)), n)
    step = 1 + np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    a, b = own[rows], (own[rows] + step) % chunks[rows]
    pair = (np.minimum(a, b).astype(np.uint64) << np.uint64(32)) + np.maximum(a, b).astype(np.uint64)
    return np.where(is_hot[rows], tokens.mix(word[rows] ^ tokens.mix(pair + np.uint64(1))), word[rows]), line[rows], pos[rows]


def _send(parts: int, ranks, threshold: float, hot):
    """Map side. part >= 0: prefix entries of a word range; < 0: lines of a set range."""
    least = least_words(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tokens.pieces(batch, "text"):
                x = Lines(piece.column("text"), ranks.value, threshold)
                ids = piece.column("id").to_numpy()[x.text]
                digest = piece.column("digest").to_numpy()[x.text]
                first, again = _repeats(x.a, x.b, ids, digest, x.line_no)
                out = list(_line_rows(x, ids, digest, first, again, parts))
                out += _entry_rows(x, ids, digest, first & (x.n >= least), parts, hot.value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], names=["part", "blob"]
                )

    return run


def _split(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(values, kind="stable")
    for rows in np.split(order, runs(values[order])[1:]):
        if len(rows):
            yield int(values[rows[0]]), rows


def _repeats(a, b, ids, digest, line_no) -> tuple[np.ndarray, np.ndarray]:
    """Whether each line is the first of its set, and whether it repeats the first; the
    same line of an equal row is neither."""
    order = np.lexsort((line_no, digest, ids, b, a))
    new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])[: len(order)]
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    first, again = np.zeros(len(order), bool), np.zeros(len(order), bool)
    first[order[new]] = True
    again[order] = (ids[order] != ids[lead]) | (digest[order] != digest[lead]) | (line_no[order] != line_no[lead])
    return first, again


def _pressed(blob: bytes) -> bytes:
    """A blob as it travels; half of its bytes are bitmaps of mostly zeros, and places of one
    text stand side by side, which the shuffle's own compression makes little of."""
    return np.uint64(len(blob)).tobytes() + pa.Codec("zstd", 1).compress(blob, asbytes=True)


def _unpressed(blob: bytes) -> bytes:
    return pa.Codec("zstd").decompress(blob[8:], int(np.frombuffer(blob, np.uint64, 1)[0]), asbytes=True)


def _line_rows(x: Lines, ids, digest, first, again, parts):
    # A line that repeats an earlier one of its piece is decided already.
    again = np.flatnonzero(again)
    home = (x.a % np.uint64(parts)).astype(np.int64)
    for part, rows in _split(home[first]):
        rows = np.flatnonzero(first)[rows]
        yield -1 - part, b"L" + pack(x.a[rows], x.b[rows], ids[rows], digest[rows], x.line_no[rows].astype(np.uint32))
    for part, rows in _split(home[again]):
        rows = again[rows]
        yield -1 - part, b"G" + pack(ids[rows], digest[rows], x.line_no[rows].astype(np.uint32))


def _entry_rows(x: Lines, ids, digest, sent, parts, hot):
    prefix = np.where(sent, x.prefix, 0)
    line = np.repeat(np.arange(len(x.n)), prefix)
    pos = np.arange(len(line)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
    word = x.words[x.starts[line] + pos] if len(line) else np.zeros(0, np.uint64)
    word, line, pos = _dealt(word, line, pos, ids, digest, x.line_no, hot)
    part = ((word >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    for p, rows in _split(part.astype(np.uint16 if parts <= 1 << 16 else np.uint32)):
        # Entries of a line stand side by side.
        begins = np.concatenate([[True], line[rows][1:] != line[rows][:-1]])
        lines = line[rows][begins]
        blob = pack(
            word[rows].astype(np.uint32), np.minimum(pos[rows], 65535).astype(np.uint16), begins.astype(np.uint8), ids[lines], digest[lines],
            x.line_no[lines].astype(np.uint32), x.n[lines].astype(np.uint32), (x.a[lines] >> np.uint64(32)).astype(np.uint32),
            x.bits[lines].ravel(),
        )
        yield p, _pressed(blob)


def _found(place: list[np.ndarray], other: list[np.ndarray] | None = None, differ=None, more=None) -> pd.DataFrame:
    """Rows of FOUND; without other the place is removed for sure."""
    n = len(place[0])
    columns = dict(zip(PLACE, [x.astype(np.int64) for x in place]))
    for i, name in enumerate(OTHER):
        columns[name] = pd.array(other[i].astype(np.int64) if other else [None] * n, dtype="Int64")
    columns["differ"] = differ if differ is not None else np.zeros(n, np.int64)
    columns["more"] = pd.array(more if more is not None else [False] * n, dtype="boolean")
    return pd.DataFrame(columns)


def _meet(threshold: float):
    """Reduce side: repeated sets of a set range, candidates of a word range."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        blobs = list(group.pop("blob"))
        if key[0] < 0:
            gone = [unpack(x[1:], *GONE) for x in blobs if x[:1] == b"G"]
            lines = [unpack(x[1:], *LINE) for x in blobs if x[:1] == b"L"]
            a, b, ids, digest, line_no = (np.concatenate(x) for x in zip(*lines))
            later = _repeats(a, b, ids, digest, line_no)[1]
            gone.append([ids[later], digest[later], line_no[later]])
            return _found([np.concatenate(x) for x in zip(*gone)])
        parts = [unpack(_unpressed(x), *ENTRY) for x in blobs]
        word, pos = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]).astype(np.int64)
        shift = np.concatenate([[0], np.cumsum([len(x[3]) for x in parts])])
        at = np.concatenate([np.cumsum(x[2], dtype=np.int64) - 1 + s for x, s in zip(parts, shift)])
        lines = [np.concatenate(x) for x in list(zip(*parts))[3:]]
        return _candidates(word, pos, at, lines, threshold)

    return run


def most_bits(both, threshold: float):
    """Bits that similar lines of so many words together differ in at most."""
    return (1 - threshold) / (1 + threshold) * both + TINY


def shared_words(n, m, i, j):
    """Most words that lines can share which hold a word at i and j of their orders."""
    return np.minimum(i, j) + np.minimum(n - i, m - j)


def inner_prefix(n, threshold: float):
    """Of so many rarest words of the shorter line a similar one holds one in its prefix."""
    return n - np.ceil(2 * threshold / (1 + threshold) * n - 1e-6).astype(np.int64) + 1


def _candidates(word, pos, at, lines, threshold) -> pd.DataFrame:
    """Earlier lines that pass the filters, for every line of a word's range.

    Lines of one word go by length and place, and each is held against the shorter ones
    and then the longer ones within the length filter, nearest first. A line with an all
    but certain candidate, or with enough of them, is done. The shorter line of a pair has
    the word in its inner prefix.
    """
    ids, digest, line_no, n, kind, bits = lines
    bits = bits.reshape(-1, BITMAP)
    # Earlier lines have smaller numbers.
    number = np.empty(len(ids), np.int64)
    number[np.lexsort((line_no, digest, ids))] = np.arange(len(ids))
    order = np.argsort(word, kind="stable")
    starts = runs(word[order])
    size = np.diff(np.append(starts, len(order)))
    order = order[np.repeat(size > 1, size)]
    order = order[np.lexsort((number[at[order]], n[at[order]], word[order]))]
    starts = runs(word[order])
    size = np.diff(np.append(starts, len(order)))
    begin, end = np.repeat(starts, size), np.repeat(starts + size, size)
    line, pos = at[order], pos[order]
    length = n[line].astype(np.int32)
    pos = pos.astype(np.int32)
    inner = pos < inner_prefix(length, threshold)
    enough_of = np.float32(threshold / (1 + threshold))
    likely_share = LIKELY * 1_000_000 * (1 - threshold) / (1 + threshold)
    done, cut = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
    passed, likely = np.zeros(len(order), np.int32), np.zeros(len(order), np.int32)
    found = []

    def hold(i, j):
        """Lines at i, each once, against those at j if earlier."""
        left = number[line[i]] > number[line[j]]
        i, j = i[left], j[left]
        both = length[i] + length[j]
        left = shared_words(length[i], length[j], pos[i], pos[j]) >= enough_of * both - np.float32(1e-3)
        i, j, both = i[left], j[left], both[left]
        x, y = line[i], line[j]
        differ = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
        most = most_bits(both, threshold)
        hit = differ <= most
        i, j, x, y, differ, most, both = i[hit], j[hit], x[hit], y[hit], differ[hit], most[hit], both[hit]
        # Equal lines were decided by their set.
        same = (differ == 0) & (kind[x] == kind[y]) & (length[i] == length[j])
        good = ~same
        strong = good & (differ <= STRONG * most - SLACK)
        share = (differ * 1_000_000 / both).astype(np.int64)
        passed[i] += good
        likely[i] += good & (share <= likely_share)
        full = (likely[i] >= ENOUGH) | (passed[i] >= MOST)
        cut[x[full]] = True
        done[x[same | strong | full]] = True
        if good.any():
            found.append(np.stack([x[good], y[good], share[good], strong[good]]))

    shorter = np.flatnonzero(inner)
    before = np.cumsum(inner) - inner
    lowest = before[begin]
    active, step = np.flatnonzero(before > lowest), 1
    while len(active):
        active = active[~done[line[active]]]
        other = shorter[before[active] - step]
        near = length[other] >= threshold * length[active] - TINY
        active = active[near]
        hold(active, other[near])
        step += 1
        active = active[before[active] - step >= lowest[active]]
    alike = np.flatnonzero(np.concatenate([[True], (begin[1:] != begin[:-1]) | (length[1:] != length[:-1])])) if len(order) else starts
    longer = np.repeat(np.append(alike, len(order))[1:], np.diff(np.append(alike, len(order))))
    active, step = np.flatnonzero(inner & (longer < end)), 0
    while len(active):
        active = active[~done[line[active]]]
        other = longer[active] + step
        near = length[active] >= threshold * length[other] - TINY
        active = active[near]
        hold(active, other[near])
        step += 1
        active = active[longer[active] + step < end[active]]
    x, y, differ, more = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
    _, first = np.unique(x * len(ids) + y, return_index=True)
    x, y, differ, more = x[first], y[first], differ[first], more[first].astype(bool)
    # Only the closest ones go on, fewer where the closest is likely to be similar; that
    # others were left out is noted.
    order = np.lexsort((number[y], differ, x))
    x, y, differ, more = x[order], y[order], differ[order], more[order]
    starts = runs(x)
    size = np.diff(np.append(starts, len(x)))
    place = np.arange(len(x)) - np.repeat(starts, size)
    most = np.repeat(np.where(differ[starts] <= likely_share, TRIED, OTHERS), size)
    more |= cut[x] | (np.repeat(size, size) > most)
    kept = place < most
    x, y, differ, more = x[kept], y[kept], differ[kept], more[kept]
    return _found([ids[x], digest[x], line_no[x]], [ids[y], digest[y], line_no[y]], differ, more)


def _rows_of_words(ranks, threshold: float, wanted):
    """Prefix entries as plain rows; of words in the bit table only, if one is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tokens.pieces(batch, "text"):
                bits = wanted and wanted()
                x = Lines(piece.column("text"), ranks.value, threshold, bits)
                line = np.repeat(np.arange(len(x.n)), x.prefix)
                pos = np.arange(len(line)) - np.repeat(np.cumsum(x.prefix) - x.prefix, x.prefix)
                word = x.words[x.starts[line] + pos] if len(line) else np.zeros(0, np.uint64)
                if bits is not None:
                    held = in_table(bits, word)
                    line, pos, word = line[held], pos[held], word[held]
                text = x.text[line]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(word.view(np.int64)), pa.array(pos), piece.column("id").take(pa.array(text)),
                        piece.column("digest").take(pa.array(text)), pa.array(x.line_no[line]), pa.array(x.n[line]),
                        *[pa.array(x.bits[line, k].view(np.int64)) for k in range(BITMAP)],
                    ],
                    names=["word", "pos", *PLACE, "n", *OWN_BITS],
                )

    return run


OWN_BITS, OTHER_BITS = ([f"{x}{k}" for k in range(BITMAP)] for x in ("bits", "other_bits"))
WORD_ROWS = ", ".join(f"{c} long" for c in ["word", "pos", *PLACE, "n", *OWN_BITS])


def _texts_of(own: DataFrame, places: DataFrame) -> DataFrame:
    """The rows of own whose text some place is in. Other texts never leave their task."""
    texts = written(places.select("id", "digest").distinct(), "line-texts")
    if texts.count() <= SMALL:
        return own.join(F.broadcast(texts), ["id", "digest"], "left_semi")
    bits = shipped(own.sparkSession, bit_table(texts.select("digest")))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest = batch.column("digest").to_numpy().view(np.uint64)
            yield batch.filter(pa.array(in_table(bits(), digest)))

    return own.mapInArrow(held, own.schema).join(texts, ["id", "digest"], "left_semi")


def _verified(own: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Adds similar to pairs, from the words (as 64-bit hashes) of both lines."""
    places = written(pairs.select(*PLACE).union(pairs.select(*OTHER).toDF(*PLACE)).distinct(), "places")
    lines = _texts_of(own, places).select("id", "digest", F.posexplode(lines_of(F.col("text"))).alias("line_no", "line"))
    lines = lines.withColumn("line_no", F.col("line_no").cast("long"))
    lines = lines.join(F.broadcast(places) if places.count() <= SMALL else places, PLACE, "left_semi")
    words = F.array_distinct(F.transform(words_of(F.col("line")), lambda w: F.xxhash64(w)))
    sets = written(lines.select(*PLACE, words.alias("words")).dropDuplicates(PLACE), "line-words")
    other = sets.toDF(*OTHER, "other_words")
    both = pairs.join(sets, PLACE).join(other, OTHER)
    shared = F.size(F.array_intersect("words", "other_words"))
    similar = shared >= (threshold - TINY) * (F.size("words") + F.size("other_words") - shared)
    return both.withColumn("similar", similar).drop("words", "other_words")


def text_digest(doc_id: Column, text: Column) -> Column:
    """63 bits of the text's hash; negative where there is an id, so that rows without one,
    which have the largest id within, come after all others."""
    bits = F.xxhash64(F.coalesce(text, F.lit("")))
    return F.when(doc_id.isNull(), bits.bitwiseAND(F.lit(int(NO_ID)))).otherwise(bits.bitwiseOR(F.lit(-int(NO_ID) - 1)))


def similar_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The lines with an earlier similar line: id, digest (of the text), line_no
    (from 0).

    doc_id is an integer; NULL comes after all of them. The digest only tells texts of the
    same id apart. Rows with equal id and text count as one document; lines without a word
    are never found.
    """
    spark = docs.sparkSession
    own = docs.select(
        F.coalesce(docs[doc_id].cast("long"), F.lit(int(NO_ID))).alias("id"),
        F.coalesce(docs[text], F.lit("")).alias("text"), text_digest(docs[doc_id], docs[text]).alias("digest"),
    )
    ranks, n_bytes = word_ranks(own.select("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // GROUP_BYTES)
    ranks = spark.sparkContext.broadcast(ranks)
    hot = spark.sparkContext.broadcast(hot_chunks(own, ranks, threshold))
    sent = own.mapInArrow(_send(parts, ranks, threshold, hot), "part int, blob binary")
    found = written(sent.groupBy("part").applyInPandas(_meet(threshold), FOUND), "met-lines")
    gone = found.filter("other_id IS NULL").select(*PLACE).distinct()
    pairs = found.filter("other_id IS NOT NULL").groupBy(*PLACE, *OTHER).agg(F.min("differ").alias("differ"), F.max("more").alias("more"))
    # Documents that are the same row twice hold the same line, not an earlier one.
    pairs = pairs.filter("id <> other_id OR digest <> other_digest OR line_no <> other_line_no")
    pairs = written(pairs.join(gone, PLACE, "left_anti"), "line-pairs")
    closest = pairs.groupBy(*PLACE).agg(F.min(F.struct("differ", *OTHER)).alias("y"), F.max("more").alias("more"), F.count(F.lit(1)).alias("n"))
    closest = closest.select(*PLACE, *[F.col(f"y.{c}").alias(c) for c in OTHER], "more", "n")
    first = written(_verified(own, closest, threshold), "line-checks")
    similar = [gone, first.filter("similar").select(*PLACE)]
    rest = pairs.join(first.filter("NOT similar AND n > 1").select(*PLACE), PLACE, "left_semi")
    rest = rest.join(first.select(*PLACE, *OTHER), PLACE + OTHER, "left_anti").select(*PLACE, *OTHER)
    second = written(_verified(own, written(rest, "line-pairs"), threshold).filter("similar").select(*PLACE).distinct(), "line-checks")
    similar.append(second)
    open_ = written(first.filter("more AND NOT similar").select(*PLACE).join(second, PLACE, "left_anti"), "open-lines")
    if open_.limit(1).count():
        similar.append(_untried(own, open_, ranks, threshold))
    lines = reduce(DataFrame.union, similar).distinct()
    return lines.withColumn("id", F.when((F.col("id") < int(NO_ID)) | (F.col("digest") < 0), F.col("id")))


def _untried(own: DataFrame, open_: DataFrame, ranks, threshold: float) -> DataFrame:
    """The open lines that any earlier line resembles, over all lines with a prefix word
    in common."""
    theirs = _texts_of(own, open_)
    words = theirs.mapInArrow(_rows_of_words(ranks, threshold, None), WORD_ROWS).join(open_, PLACE, "left_semi")
    words = written(words.distinct(), "open-words")
    wanted = shipped(own.sparkSession, bit_table(words.select("word")))
    every = own.mapInArrow(_rows_of_words(ranks, threshold, wanted), WORD_ROWS).toDF("word", "j", *OTHER, "m", *OTHER_BITS)
    both = words.join(every, "word")
    differ = sum((F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in zip(OWN_BITS, OTHER_BITS)), F.lit(0))
    total = (F.col("n") + F.col("m")) / (1 + threshold)
    shared = F.least("pos", "j") + F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("j"))
    earlier = F.struct(*OTHER) < F.struct(*[F.col(c).alias(o) for c, o in zip(PLACE, OTHER)])
    inner = lambda n: n - F.ceil(2 * threshold / (1 + threshold) * n - 1e-6) + 1
    n, m = F.col("n"), F.col("m")
    held = ((n >= m) & (F.col("j") < inner(m))) | ((n <= m) & (F.col("pos") < inner(n)))
    fits = held & (F.least("n", "m") >= threshold * F.greatest("n", "m") - TINY) & (shared >= threshold * total - TINY) & (differ <= (1 - threshold) * total + TINY)
    pairs = written(both.filter(earlier & fits).select(*PLACE, *OTHER).distinct(), "open-pairs")
    return _verified(own, pairs, threshold).filter("similar").select(*PLACE).distinct()


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of docs, their text less the lines with an earlier similar line,
    and n_removed (long).

    Lines without a word stay. A text whose lines all go becomes empty, a NULL text stays
    NULL, and rows with equal doc_id and text are cut alike.
    """
    gone = similar_lines(docs, doc_id, text, threshold)
    each = gone.groupBy("id", "digest").agg(F.sort_array(F.collect_list(F.struct("line_no"))).alias("gone"))
    each = each.withColumn("gone", F.transform("gone", lambda x: F.struct(x["line_no"].cast("int").alias("line_no"))))
    df = without_lines(docs, each, doc_id, text, text_digest(docs[doc_id], docs[text]))
    return df.withColumn("n_removed", F.coalesce(F.size("_gone"), F.lit(0)).cast("long")).drop("_lines", "_gone")
