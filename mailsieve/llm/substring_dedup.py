"""Repeated passages removed by hashing lines and runs of lines.

Every unit of at least min_words words is normalised (lower case, white space collapsed)
and its digest grouped over all documents; the earliest occurrence by (doc_id, place in
the text) stays and the others go, each with its place in the original text. Only digests
move until the removals return to their documents, and the earliest place of a digest is
an aggregate that combines before the shuffle, so a very common line is no hot group.

A unit is a line or, with runs, the shortest run of whole lines that reaches min_words
forward or backward from a line. Runs depend on nothing outside them, and those that
start at a passage's first line or end at its last cover every passage of whole lines
that is long enough, however short its lines are and whatever stands around it.

Passages that begin or end inside lines, or are wrapped in other places, have units of
their own: of all stretches of WINDOW words, the one with the least hash among every
(least - WINDOW + 1) stretches in a row. Which ones these are depends on nothing outside
them, so two texts that share least words share a unit, wherever it stands. A repeated
unit takes the words up to the end of the text's next unit with it if they are the same in
both places; what stays of a passage is less than least - WINDOW + 1 words at either end.
Only units that occur twice are looked for in a second reading of the texts, behind a bit
table of fixed size; digests of 128 bits decide.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.common import SPACES, lines_of, shipped
from mailsieve.llm.tokens import BASE, _hashes, _Powers, mix, pieces, text_bytes
from mailsieve.session import written

MIN_WORDS = 20
# Where words are not parted by spaces (Thai to Myanmar, Khmer, kana, Han) each character
# counts as one.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WINDOW = 20
PIECE = 1 << 20
#: Bits of the table of units that occur twice, as a power of two.
BITS = 26
COUNTED = re.compile(f"[{UNSPACED}]|[^ {UNSPACED}]+")


def _plain(text: Column) -> Column:
    return F.transform(lines_of(text), lambda x: F.trim(F.regexp_replace(F.lower(x), SPACES, " ")))


def units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """id, digest of the text, line_no (from 0) and unit (MD5 of the normalised line)."""
    df = docs.select(docs[doc_id].alias("id"), F.coalesce(docs[text], F.lit("")).alias("content"))
    df = df.select("id", F.xxhash64("content").alias("digest"), F.posexplode(_plain(F.col("content"))).alias("line_no", "line"))
    n_words = F.length("line") - F.length(F.translate("line", " ", "")) + 1
    return df.filter((F.col("line") != "") & (n_words >= min_words)).select(
        "id", "digest", "line_no", F.unhex(F.md5("line")).alias("unit")
    )


def spans(sizes: list[int], least: int) -> set[tuple[int, int]]:
    """First and last of the shortest runs of sizes that sum up to least, forward and
    backward from each place; empty places neither begin nor end a run."""
    out, first, last, total, filled = set(), 0, -1, 0, [i for i, n in enumerate(sizes) if n]
    for i in filled:
        # Forward: the shortest run from i.
        while total < least and last + 1 < len(filled):
            last += 1
            total += sizes[filled[last]]
        if total < least:
            break
        out.add((i, filled[last]))
        total -= sizes[i]
    total = 0
    for i in filled:
        # Backward: the shortest run up to i.
        total += sizes[i]
        while total - sizes[filled[first]] >= least:
            total -= sizes[filled[first]]
            first += 1
        if total >= least:
            out.add((filled[first], i))
    return out


def _runs(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                lines = batch.column("lines")[row].as_py()
                found = sorted(spans([len(COUNTED.findall(x)) for x in lines], least))
                one = pa.array([row] * len(found), pa.int32())
                keys = [hashlib.md5(" ".join(x for x in lines[i : j + 1] if x).encode()).digest() for i, j in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(one), batch.column("digest").take(one), pa.array([i for i, _ in found], pa.int32()),
                        pa.array([j for _, j in found], pa.int32()), pa.array(keys, pa.binary()),
                    ],
                    names=["id", "digest", "line_no", "last", "unit"],
                )

    return run


def runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """id, digest of the text, line_no and last (first and last line of a run), unit."""
    content = F.coalesce(docs[text], F.lit(""))
    df = docs.select(docs[doc_id].alias("id"), F.xxhash64(content).alias("digest"), _plain(content).alias("lines"))
    kind = df.schema["id"].dataType.simpleString()
    return df.mapInArrow(_runs(min_words), f"id {kind}, digest long, line_no int, last int, unit binary")


def repeats(found: DataFrame) -> DataFrame:
    """The lines of units that are not the first of their kind: id, digest, line_no, kept_in.

    NULL ids come last. Rows with equal id and text count as one document. A run that
    overlaps the first of its kind is no repeat; of several first places the earliest
    is named.
    """
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "digest", "line_no")
    whole = "last" in found.columns
    kept = F.struct(place.alias("at"), "last") if whole else F.struct(place.alias("at"))
    first = found.groupBy("unit").agg(F.min(kept).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = found.join(first.drop("n"), "unit").filter(place != F.col("first.at"))
    if not whole:
        return rows.select("id", "digest", "line_no", F.col("first.at.id").alias("kept_in")).distinct()
    same = F.col("id").eqNullSafe(F.col("first.at.id")) & (F.col("digest") == F.col("first.at.digest"))
    rows = rows.filter(~same | (F.col("line_no") > F.col("first.last")))
    lines = rows.select("id", "digest", F.explode(F.sequence("line_no", "last")).alias("line_no"), F.col("first.at").alias("at"))
    least = lines.groupBy("id", "digest", "line_no").agg(F.min("at").alias("at"))
    return least.select("id", "digest", "line_no", F.col("at.id").alias("kept_in"))


def _lower_table() -> np.ndarray:
    """Lower case of the characters below U+10000 that have one of one character."""
    out = np.arange(1 << 16, dtype=np.uint32)
    for i in range(1 << 16):
        low = chr(i).lower()
        if len(low) == 1:
            out[i] = ord(low)
    return out


def _alone() -> np.ndarray:
    """Which characters below U+40000 are words of their own."""
    out = np.zeros(1 << 18, bool)
    for part in re.findall("(.)-(.)", UNSPACED):
        out[ord(part[0]) : ord(part[1]) + 1] = True
    return out


class _Tables:
    lower = alone = None

    @classmethod
    def get(cls) -> tuple[np.ndarray, np.ndarray]:
        if cls.lower is None:
            cls.lower, cls.alone = _lower_table(), _alone()
        return cls.lower, cls.alone


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Least or largest (pick) of every width values in a row, by doubling."""
    have = 1
    while 2 * have <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def selected(column: pa.Array, least: int) -> tuple[np.ndarray, ...]:
    """Units of the texts: text number, start and end in code points of the text, digest in
    two halves, digest of the words up to the end of the text's next unit, and that end (0
    and the unit's own end for the last)."""
    lower, alone = _Tables.get()
    data, offsets = text_bytes(column)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    begin = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    low = np.where(points < 1 << 16, lower[np.minimum(points, (1 << 16) - 1)], points)
    single = alone[np.minimum(points, (1 << 18) - 1)] & (points < 1 << 18)
    inside = ~((points == 0x20) | ((points >= 0x09) & (points <= 0x0D)))
    first, last = inside.copy(), inside.copy()
    edge = np.zeros(len(points) + 1, bool)
    edge[begin] = True
    first[1:] &= ~inside[:-1] | single[1:] | single[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | single[:-1] | single[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    none = np.zeros(0, np.int64)
    if len(starts) < WINDOW:
        return (none,) * 7
    words = _hashes(low, starts, ends)
    text = np.searchsorted(begin, starts, side="right") - 1
    up, down = _Powers.upto(len(words) + 1)
    halves, sums = [], None
    for salt in (0, 1):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words + np.uint64(salt * BASE % 2**64)) * up[: len(words)])])
        halves.append(mix((sums[WINDOW:] - sums[:-WINDOW]) * down[: len(words) - WINDOW + 1] + np.uint64(salt)))
    # The stretch at word i, if it lies in one text; number of stretches of each text.
    whole = text[: len(halves[0])] == text[WINDOW - 1 :]
    at = np.flatnonzero(whole)
    key, of = halves[0][at], text[at]
    span = least - WINDOW + 1
    chosen = np.zeros(len(at), bool)
    if len(at) >= span:
        full = of[: len(at) - span + 1] == of[span - 1 :]
        minima = np.where(full, _slide(key, span, np.minimum), 0)
        pad = np.zeros(span - 1, np.uint64)
        chosen = _slide(np.concatenate([pad, minima, pad]), span, np.maximum) == key
    # A text with fewer stretches than that gives its least one.
    few = np.bincount(of, minlength=len(column))
    short = np.flatnonzero((few > 0) & (few < span))
    if len(short):
        lowest = np.full(len(column), np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(lowest, of, key)
        chosen |= (few[of] < span) & (key == lowest[of])
    at = at[chosen]
    shift, stop = begin[text[at]], ends[at + WINDOW - 1]
    after, bridge = stop.copy(), np.zeros(len(at), np.uint64)
    more = np.flatnonzero(text[at[1:]] == text[at[:-1]])
    after[more] = stop[more + 1]
    bridge[more] = mix((sums[at[more + 1] + WINDOW] - sums[at[more]]) * down[at[more]] + np.uint64(2))
    signed = [x.view(np.int64) for x in (halves[0][at], halves[1][at], bridge)]
    return text[at], starts[at] - shift, stop - shift, *signed, after - shift


def passages(docs: DataFrame, least: int, doc_id: str = "doc_id", text: str = "text", table: np.ndarray | None = None) -> DataFrame:
    """id, digest of the text, begin and stop (code points), u1, u2, bridge and after of every
    unit (see selected), or of those in the bit table."""
    held = shipped(docs.sparkSession, table)
    content = F.coalesce(docs[text], F.lit(""))
    df = docs.select(docs[doc_id].alias("id"), F.xxhash64(content).alias("digest"), content.alias("text"))

    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                of, *values = selected(piece.column("text"), least)
                if held() is not None:
                    bit = values[2].view(np.uint64) & np.uint64((1 << BITS) - 1)
                    good = (held()[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
                    of, values = of[good], [x[good] for x in values]
                one = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id").take(one), piece.column("digest").take(one), *[pa.array(x, kind) for x, kind in zip(values, kinds)]],
                    names=["id", "digest", "begin", "stop", "u1", "u2", "bridge", "after"],
                )

    kind = df.schema["id"].dataType.simpleString()
    return df.mapInArrow(run, f"id {kind}, digest long, begin int, stop int, u1 long, u2 long, bridge long, after int")


def _bits(units: DataFrame) -> np.ndarray:
    """Bit table of u1; as many bits whatever the number of units."""
    slot = F.expr(f"shiftrightunsigned(u1 & {(1 << BITS) - 1}L, 6)").alias("slot")
    found = units.select(slot, F.expr("shiftleft(1L, CAST(u1 & 63L AS INT))").alias("bit")).groupBy("slot").agg(F.expr("bit_or(bit)").alias("bits")).toArrow()
    out = np.zeros(1 << BITS - 6, np.uint64)
    out[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def repeated_passages(docs: DataFrame, least: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Units that are not the first of their kind: id, digest, begin, stop, kept_in.

    Order and equal rows as in repeats(); a unit that overlaps the first of its kind in the
    same text is no repeat.
    """
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "digest", "begin", "stop", "bridge")
    first = passages(docs, least, doc_id, text).groupBy("u1", "u2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    first = written(first.filter("n > 1").drop("n"), "passages")
    rows = passages(docs, least, doc_id, text, _bits(first)).join(first, ["u1", "u2"])
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("digest") == F.col("first.digest"))
    rows = rows.filter(~same | (F.col("begin") >= F.col("first.stop")))
    on = (F.col("bridge") == F.col("first.bridge")) & (F.col("bridge") != 0)
    rows = rows.withColumn("stop", F.when(on, F.col("after")).otherwise(F.col("stop")))
    return rows.groupBy("id", "digest", "begin", "stop").agg(F.min("first").alias("first")).select("id", "digest", "begin", "stop", F.col("first.id").alias("kept_in"))


def cut(text: str, gone: list[tuple[bool, int, int, str]]) -> tuple[str, list[str]]:
    """The text without what is gone, and what went as start:end:kept_in in order.

    gone holds (False, line number, line number, kept_in) and (True, start, end, kept_in).
    Spans are cut at line ends; a line that goes whole takes its line feed with it.
    """
    lines = {first: kept for inside, first, _, kept in gone if not inside}
    spans = sorted((first, stop, kept) for inside, first, stop, kept in gone if inside)
    left, out, at, k = [], [], 0, 0
    open_spans: list[tuple[int, int, str]] = []
    for no, line in enumerate(text.split("\n")):
        end = at + len(line)
        open_spans = [x for x in open_spans if x[1] > at]
        while k < len(spans) and spans[k][0] < end:
            open_spans.append(spans[k])
            k += 1
        if no in lines:
            out.append(f"{at}:{end}:{lines[no]}")
        else:
            joined: list[list] = []
            for start, stop, kept in open_spans:
                start, stop = max(start, at), min(stop, end)
                if start >= stop:
                    continue
                if joined and start <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], stop)
                else:
                    joined.append([start, stop, kept])
            out += [f"{a}:{b}:{kept}" for a, b, kept in joined]
            if not joined:
                left.append(line)
            elif joined[0][:2] != [at, end]:
                edges = [at, *[x for a, b, _ in joined for x in (a, b)], end]
                left.append("".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
        at = end + 1
    return "\n".join(left), out


def _cut_all(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
    rows = []
    for text, places in zip(texts, gone):
        if text is None or places is None:
            rows.append((None, 0, ""))
        else:
            kept, spans = cut(text, [(x["inside"], x["first"], x["stop"], x["kept_in"]) for x in places])
            rows.append((kept, len(spans), ",".join(spans)))
    return pd.DataFrame(rows, columns=["text", "n", "spans"])


def dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, by_runs: bool = True, least: int = 0
) -> DataFrame:
    """All rows and columns of docs with what repeats cut out of text, and added:

    n_removed, and removed: start:end:kept_in of every line or part of a line cut, in code
    points of the original text, end exclusive, comma-joined in order. Lines are parted by a
    line feed; a document whose lines all go keeps an empty text, a NULL text stays NULL.
    by_runs=False takes single lines only. least (WINDOW at least) also takes passages of so
    many words wherever they begin and end; 0 leaves them. Columns of docs called n_removed
    or removed give way to the results; an empty table gives no rows.
    """
    found = (runs if by_runs else units)(docs, doc_id, text, min_words)
    lines = repeats(written(found, "units"))
    kept = F.coalesce(F.col("kept_in").cast("string"), F.lit("")).alias("kept_in")
    gone = lines.select("id", "digest", F.struct(F.lit(False).alias("inside"), F.col("line_no").alias("first"), F.col("line_no").alias("stop"), kept).alias("x"))
    if least:
        spans = repeated_passages(docs, max(least, WINDOW), doc_id, text)
        gone = gone.unionAll(spans.select("id", "digest", F.struct(F.lit(True).alias("inside"), F.col("begin").alias("first"), "stop", kept).alias("x")))
    gone = gone.groupBy("id", "digest").agg(F.collect_list("x").alias("_gone")).withColumnsRenamed({"id": "_gone_id", "digest": "_gone_digest"})
    rest = [c for c in docs.columns if c not in ("n_removed", "removed")]
    packed = docs.select(F.struct(*[docs[c] for c in rest]).alias("_row"), docs[doc_id].alias("_id"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("_digest"))
    same = F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_digest") == F.col("_gone_digest"))
    after = F.pandas_udf(_cut_all, "text string, n long, spans string")
    full = F.col(f"_row.{text}")
    df = packed.join(gone, same, "left").select("_row", F.col("_gone").isNotNull().alias("_hit"), after(F.when(F.col("_gone").isNotNull(), full), "_gone").alias("_cut"))
    columns = [F.col(f"_row.{c}").alias(c) if c != text else F.when(F.col("_hit"), F.coalesce("_cut.text", full)).otherwise(full).alias(c) for c in rest]
    return df.select(*columns, F.col("_cut.n").alias("n_removed"), F.col("_cut.spans").alias("removed"))
