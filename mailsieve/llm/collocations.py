"""Phrases whose words come together more often than their parts suggest.

Counting. Each task keeps its phrases in a HAT-trie: a shallow trie over word ids whose
leaves are hash containers from the rest of a phrase to its count. A container that grows
beyond BURST entries bursts into a node with a container for each next word. When the trie
holds MOST entries, whole subtrees (the largest first) leave it as sorted runs; the runs
are dealt by prefix (language and first word) and merged there. A subtree holds its first
word once, and the subtrees of a prefix partition are one row. A phrase leaves a task once per run however often it occurs; the
subtrees of words that are a large part of all (fewer than HEADS can be) are dealt in shares
by the digest of their further words, so a very common word is no hot group.

Levels. A phrase with a count of LEAST has only parts with at least that count, so words are
counted first, then pairs of frequent words, then longer phrases of frequent pairs. What is
frequent reaches the tasks as a bit table of fixed size: an unlucky bit lets a rare phrase
be counted too, which costs time and changes no result, as phrases are merged as whole
strings and the exact counts decide. The texts are read once a level, whole and in place.

Scores are exact: products are decimals of 38 digits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailsieve.llm.common import shipped
from mailsieve.llm.tokens import BASE, _hashes, mix, pieces, text_bytes
from mailsieve.session import small_side, written

LEAST = 100
TOP = 2000
LONGEST = 5
NO_LANG = "und"
#: Entries of a container that bursts, entries of a trie that spills, words known to a task.
BURST = 4096
MOST = 600_000
MOST_WORDS = 400_000
PIECE = 4 << 20
#: Bits of the table of frequent phrases, as a power of two.
BITS = 26
ID = 4
#: Prefix partitions of the runs; what parts the rests of a subtree (in no word).
PARTS = 1 << 14
SPLIT = "\n"
#: A head with more than one in HEADS of all words is dealt in shares.
HEADS = 1000
SALTS = 64

KIND = np.zeros(256, np.int8)  # 0: in a word, 1: between words, 2: between pieces
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?\x0a\x0b\x0c\x0d"]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Node:
    """A burst container: a child for each next word."""

    __slots__ = ("children",)

    def __init__(self) -> None:
        self.children: dict[bytes, Node | dict] = {}

    def add(self, rest: bytes, count: int) -> bool:
        """Add a count; whether the phrase is new."""
        key, tail = rest[:ID], rest[ID:]
        child = self.children.get(key)
        if isinstance(child, Node):
            return child.add(tail, count)
        if child is None:
            child = self.children[key] = {}
        held = child.get(tail)
        child[tail] = count if held is None else held + count
        if len(child) > BURST:
            self.children[key] = burst(child)
        return held is None

    def walk(self, prefix: bytes) -> Iterator[tuple[bytes, int]]:
        for key, child in self.children.items():
            if isinstance(child, Node):
                yield from child.walk(prefix + key)
            else:
                for rest, count in child.items():
                    yield prefix + key + rest, count


def burst(container: dict[bytes, int]) -> Node:
    """A node in place of a container; phrases that end at the node stay in a container
    under the empty key."""
    node = Node()
    for rest, count in container.items():
        child = node.children.setdefault(rest[:ID], {})
        child[rest[ID:]] = child.get(rest[ID:], 0) + count
    return node


@dataclass
class Trie:
    """Counts of phrases of word ids (four bytes each), by language and first word."""

    root: dict[tuple[int, int], Node | dict] = field(default_factory=dict)
    sizes: dict[tuple[int, int], int] = field(default_factory=dict)
    total: int = 0

    def add(self, first: tuple[int, int], rests: list[bytes], counts: list[int]) -> None:
        """Add the counts of phrases that begin alike; rests are their further words."""
        held = self.root.get(first)
        if held is None:
            held = self.root[first] = {}
        grown = 0
        if isinstance(held, Node):
            for rest, count in zip(rests, counts):
                grown += held.add(rest, count)
        else:
            before = len(held)
            for rest, count in zip(rests, counts):
                held[rest] = held.get(rest, 0) + count
            grown = len(held) - before
            if len(held) > BURST:
                self.root[first] = burst(held)
        self.sizes[first] = self.sizes.get(first, 0) + grown
        self.total += grown

    def largest(self, upto: int) -> list[tuple[int, int]]:
        """First words of the largest subtrees without which at most upto entries stay."""
        out, left = [], self.total
        for first in sorted(self.sizes, key=self.sizes.get, reverse=True):
            if left <= upto:
                break
            out.append(first)
            left -= self.sizes[first]
        return out

    def drain(self, firsts: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[bytes], list[int]]]:
        """Take whole subtrees out: language, first word, further words, counts."""
        for first in firsts:
            held = self.root.pop(first)
            self.total -= self.sizes.pop(first)
            if isinstance(held, Node):
                rests, counts = map(list, zip(*held.walk(b"")))
            else:
                rests, counts = list(held), list(held.values())
            yield *first, rests, counts


TREES = pa.list_(pa.struct([("lang", pa.string()), ("head", pa.string()), ("rests", pa.string()), ("counts", pa.list_(pa.int64()))]))


@dataclass
class Task:
    """What one task knows: numbers of its words and languages, and its trie."""

    words: list[str] = field(default_factory=list)
    numbers: dict[str, int] = field(default_factory=dict)
    langs: list[str] = field(default_factory=list)
    lang_numbers: dict[str, int] = field(default_factory=dict)
    trie: Trie = field(default_factory=Trie)

    def number(self, known: dict[str, int], names: list[str], found: list[str]) -> np.ndarray:
        for x in found:
            if x not in known:
                known[x] = len(names)
                names.append(x)
        return np.fromiter((known[x] for x in found), np.int64, len(found))

    def spill(self, firsts: list[tuple[int, int]], shares: dict[tuple[str, str], int]) -> Iterator[pa.RecordBatch]:
        """Whole subtrees as sorted runs: a row for each prefix partition with its subtrees."""
        parts: dict[int, list[dict]] = {}
        for lang, head, rests, counts in self.trie.drain(firsts):
            name, word = self.langs[lang], self.words[head]
            run = sorted(zip(self.strings(rests), counts))
            n = shares.get((name, word), 1)
            split = [run] if n == 1 else [[] for _ in range(n)]
            if n > 1:
                for x in run:
                    split[zlib.crc32(x[0].encode()) % n].append(x)
            for k, part in enumerate(split):
                if part:
                    tree = {"lang": name, "head": word, "rests": SPLIT.join([x for x, _ in part]), "counts": [c for _, c in part]}
                    parts.setdefault(zlib.crc32(f"{k} {name} {word}".encode()) % PARTS, []).append(tree)
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array(list(parts.values()), TREES)], names=["part", "trees"])

    def strings(self, rests: list[bytes]) -> list[str]:
        """Further words as text."""
        numbers = np.frombuffer(b"".join(rests), ">u4").tolist()
        words = [self.words[i] for i in numbers]
        if len(words) == len(rests):
            return words
        out, at = [], 0
        for rest in rests:
            n = len(rest) // ID
            out.append(" ".join(words[at : at + n]))
            at += n
        return out


def lang_hashes(names: list[str]) -> np.ndarray:
    data = [x.encode() for x in names]
    ends = np.cumsum([len(x) for x in data], dtype=np.int64)
    return _hashes(np.frombuffer(b"".join(data), np.uint8), ends - [len(x) for x in data], ends) if data else np.zeros(0, np.uint64)


def phrase_hash(lang: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    """Hash of language and words in order, for the bit table."""
    out = lang
    for part in parts:
        out = mix(out * np.uint64(BASE) + part)
    return out


def has(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes & np.uint64((1 << BITS) - 1)
    return (table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


@dataclass
class Runs:
    """Words of some texts: their strings, hashes, language (a number), and the run of words
    (a piece of a text, less the words left out) that each belongs to."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    lang: np.ndarray
    run: np.ndarray

    def keep(self, mask: np.ndarray, apart: np.ndarray) -> Runs:
        """The words of mask; apart marks words that begin a new run."""
        run = np.cumsum(apart)[mask]
        return Runs(self.data, self.starts[mask], self.ends[mask], self.hashes[mask], self.lang[mask], run)

    def strings(self) -> pa.Array:
        """The words, for numbering."""
        width = self.ends - self.starts
        offsets = np.concatenate([[0], np.cumsum(width)])
        at = np.arange(offsets[-1]) + np.repeat(self.starts - offsets[:-1], width)
        return pa.LargeStringArray.from_buffers(len(width), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(self.data[at]))


def read(column: pa.Array, lang: np.ndarray) -> Runs:
    """Words of texts in order; lang has a number per text."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    kind = KIND[data]
    inside = kind == 0
    full = offsets[:-1][np.diff(offsets) > 0]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[full] = inside[full]
    stops[:-1] &= ~inside[1:]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    stops[last] = inside[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    text = np.searchsorted(offsets, starts, side="right") - 1
    # A piece ends at a separator and with its text.
    run = np.searchsorted(np.flatnonzero(kind == 2), starts) + text
    return Runs(data, starts, ends, _hashes(data, starts, ends), lang[text], run)


def frequent_runs(r: Runs, lang: np.ndarray, words: np.ndarray, pairs: np.ndarray | None) -> Runs:
    """What can be in frequent phrases: runs of words in the table, all of whose neighbours
    are pairs in the table. lang has the hash of each language."""
    good = has(words, phrase_hash(lang[r.lang], [r.hashes]))
    r = r.keep(good, _new_runs(r.run) | ~good | _after(~good))
    if pairs is not None and len(r.run):
        joined = np.zeros(len(r.run), bool)
        joined[1:] = r.run[1:] == r.run[:-1]
        joined[1:] &= has(pairs, phrase_hash(lang[r.lang[:-1]], [r.hashes[:-1], r.hashes[1:]]))
        r = r.keep(np.ones(len(r.run), bool), ~joined)
    return r


def _new_runs(run: np.ndarray) -> np.ndarray:
    out = np.ones(len(run), bool)
    out[1:] = run[1:] != run[:-1]
    return out


def _after(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask), bool)
    out[1:] = mask[:-1]
    return out


def grow(task: Task, r: Runs, shortest: int, longest: int) -> None:
    """Add the phrases of shortest (2 at least) to longest words to the task's trie."""
    if not len(r.run):
        return
    coded = r.strings().dictionary_encode()
    numbers = task.number(task.numbers, task.words, coded.dictionary.to_pylist())
    word = numbers[coded.indices.to_numpy(zero_copy_only=False)]
    width = len(task.words)
    at = np.arange(len(word))
    node = r.lang
    for length in range(1, longest + 1):
        if length > 1:
            ok = at + length <= len(word)
            at, node = at[ok], node[ok]
            ok = r.run[at] == r.run[at + length - 1]
            at, node = at[ok], node[ok]
        # Nodes of one level in trie order: by the node above, then by word.
        keys = node * width + word[at + length - 1]
        _, first, node, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        if length < shortest or not len(at):
            continue
        first = at[first]
        rest = np.stack([word[first + k] for k in range(1, length)], axis=1).astype(">u4").tobytes()
        step = ID * (length - 1)
        rests = [rest[i : i + step] for i in range(0, len(rest), step)]
        heads = r.lang[first] * width + word[first]
        cut = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1], [True]])).tolist()
        counts, langs, words_at = counts.tolist(), r.lang[first].tolist(), word[first].tolist()
        for i, j in zip(cut, cut[1:]):
            task.trie.add((langs[i], words_at[i]), rests[i:j], counts[i:j])


def words_of(docs: DataFrame) -> DataFrame:
    """lang, phrase and n: counts of single words, and of all words under the empty phrase;
    one hash container per language, spilled when they hold MOST_WORDS entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, int]] = {}

        def out():
            for lang, counts in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                    names=["lang", "phrase", "n"],
                )

        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                coded = pc.fill_null(piece.column("lang"), NO_LANG).dictionary_encode()
                names = coded.dictionary.to_pylist()
                r = read(piece.column("text"), coded.indices.to_numpy(zero_copy_only=False))
                words = r.strings().dictionary_encode()
                width = max(len(words.dictionary), 1)
                keys, counts = np.unique(r.lang.astype(np.int64) * width + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
                found = words.dictionary.take(pa.array(keys % width)).to_pylist()
                cut = np.searchsorted(keys, np.arange(len(names) + 1) * width).tolist()
                counts = counts.tolist()
                for name, i, j in zip(names, cut, cut[1:]):
                    own = held.setdefault(name, {"": 0})
                    own[""] += sum(counts[i:j])
                    for word, n in zip(found[i:j], counts[i:j]):
                        own[word] = own.get(word, 0) + n
                if sum(map(len, held.values())) > MOST_WORDS:
                    yield from out()
                    held.clear()
        yield from out()

    return docs.mapInArrow(run, "lang string, phrase string, n long")


def runs_of(
    docs: DataFrame, shortest: int, longest: int, words: np.ndarray, pairs: np.ndarray | None = None, shares: dict[tuple[str, str], int] | None = None
) -> DataFrame:
    """Sorted runs of phrases of two words or more: part (the prefix partition) and trees, of
    lang, head (the first word), rests (the further words, parted by SPLIT) and counts. docs
    has lang and text."""
    tables = shipped(docs.sparkSession, (words, pairs, shares or {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, (words, pairs, shares) = Task(), tables()
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                coded = pc.fill_null(piece.column("lang"), NO_LANG).dictionary_encode()
                numbers = task.number(task.lang_numbers, task.langs, coded.dictionary.to_pylist())
                r = read(piece.column("text"), numbers[coded.indices.to_numpy(zero_copy_only=False)])
                grow(task, frequent_runs(r, lang_hashes(task.langs), words, pairs), shortest, longest)
                if len(task.words) > MOST_WORDS:
                    yield from task.spill(list(task.trie.root), shares)
                    task = Task()
                elif task.trie.total > MOST:
                    yield from task.spill(task.trie.largest(MOST // 2), shares)
        yield from task.spill(list(task.trie.root), shares)

    return docs.mapInArrow(run, "part int, trees array<struct<lang: string, head: string, rests: string, counts: array<long>>>")


def merged(runs: DataFrame, least: int) -> DataFrame:
    """lang, phrase and a of the phrases that the runs hold at least so often. Runs are dealt
    by prefix partition and merged there."""
    entry = lambda t: F.arrays_zip(
        F.transform(F.split(t["rests"], SPLIT), lambda x: F.struct(t["lang"].alias("lang"), F.concat(t["head"], F.lit(" "), x).alias("phrase"))).alias("key"),
        t["counts"].alias("n"),
    )
    each = runs.repartition("part").select("part", F.explode(F.flatten(F.transform("trees", entry))).alias("x"))
    counts = each.groupBy("part", F.col("x.key.lang").alias("lang"), F.col("x.key.phrase").alias("phrase")).agg(F.sum("x.n").alias("a"))
    return counts.filter(F.col("a") >= least).select("lang", "phrase", "a")


def shares_of(single: DataFrame) -> dict[tuple[str, str], int]:
    """In how many shares the runs of a hot first word are dealt; fewer than HEADS words
    can hold more than one in HEADS of all."""
    total = single.filter("phrase = ''").agg(F.sum("a")).first()[0] or 0
    hot = single.filter((F.col("phrase") != "") & (F.col("a") * HEADS > total))
    return {(r["lang"], r["phrase"]): -(-r["a"] * HEADS // total) for r in hot.collect()}


def table_of(phrases: DataFrame) -> np.ndarray:
    """Bit table of (lang, phrase); as many bits whatever the number of phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = lang_hashes(batch.column("lang").to_pylist())
            phrases = [p.encode().split(b" ") for p in batch.column("phrase").to_pylist()]
            flat = [w for p in phrases for w in p]
            ends = np.cumsum([len(w) for w in flat], dtype=np.int64)
            if not len(ends):
                continue
            hashes = _hashes(np.frombuffer(b"".join(flat), np.uint8), ends - [len(w) for w in flat], ends).reshape(len(phrases), -1)
            bit = phrase_hash(lang, [hashes[:, k] for k in range(hashes.shape[1])]) & np.uint64((1 << BITS) - 1)
            slot, at = np.unique(bit >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(slot), np.uint64)
            np.bitwise_or.at(bits, at, np.uint64(1) << (bit & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(bits.view(np.int64))], names=["slot", "bits"])

    found = phrases.select("lang", "phrase").mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    out = np.zeros(1 << BITS - 6, np.uint64)
    out[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def phrases(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, a) of all phrases of 1 to longest words that occur at least so often,
    and (lang, n) with the number of words."""
    rows = docs.select(docs[lang].cast("string").alias("lang"), docs[text].alias("text")).filter("text IS NOT NULL")
    counts = words_of(rows).groupBy("lang", "phrase").agg(F.sum("n").alias("a"))
    single = written(counts.filter((F.col("a") >= least) | (F.col("phrase") == "")), "words")
    found = [single.filter("phrase <> ''")]
    if longest > 1:
        words, shares = table_of(found[0]), shares_of(single)
        found.append(written(merged(runs_of(rows, 2, 2, words, None, shares), least), "pairs"))
        if longest > 2:
            found.append(written(merged(runs_of(rows, 3, longest, words, table_of(found[1]), shares), least), "phrases"))
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    return every, single.filter("phrase = ''").select("lang", F.col("a").alias("n"))


def scored(every: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of all candidates: the cut of lowest score, the
    smallest on ties."""
    size = F.length("phrase") - F.length(F.translate("phrase", " ", "")) + 1
    cand = every.withColumn("size", size).filter("size > 1")
    cuts = cand.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("right", F.expr("substring(phrase, length(left) + 2)"))
    part = lambda side, n: every.select("lang", F.col("phrase").alias(side), F.col("a").alias(n))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(small_side(totals), "lang")
    big = lambda c: f"CAST({c} AS DECIMAL(38, 0))"
    score = F.expr(f"({big('1000')} * {big('a')} * {big('n')}) div ({big('l')} * {big('r')})")
    cuts = cuts.withColumn("score", score.cast("long"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r", "n")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.n", "cut.score")


def absorbed(every: DataFrame) -> DataFrame:
    """lang, phrase and longer: the highest count of the phrases one word longer around it.

    A longer candidate as frequent as a phrase inside it makes all between them as frequent
    too, so one word more is all that must be looked at.
    """
    size = F.length("phrase") - F.length(F.translate("phrase", " ", "")) + 1
    long = every.filter(size > 2)
    heads = long.select("lang", F.expr("substring(phrase, 1, length(phrase) - length(substring_index(phrase, ' ', -1)) - 1)").alias("phrase"), "a")
    tails = long.select("lang", F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)").alias("phrase"), "a")
    return heads.unionAll(tails).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases.

    A-Z are lower-cased; pieces end at . , ; : ! ? and U+000A to U+000D, words are parted by
    spaces and tabs. A candidate that a longer one as frequent holds is dropped. Order:
    score and a descending, phrase in byte order. A NULL language counts as 'und', a NULL
    or empty text has no words; repeated rows count each; an empty table gives no rows.
    """
    every, totals = phrases(docs, lang, text, least, longest)
    left = scored(every, totals).join(absorbed(every), ["lang", "phrase"], "left").filter("longer IS NULL OR longer < a").drop("longer")
    # The first of each salt, then the first of those: a language that holds most candidates
    # is sorted in SALTS tasks and sends at most top rows from each.
    order = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase"))
    salted = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = salted.withColumn("rank", order("lang", "salt")).filter(F.col("rank") <= top).drop("salt")
    ranked = few.withColumn("rank", order("lang")).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
