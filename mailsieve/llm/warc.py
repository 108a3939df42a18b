"""WARC archives written and read back by byte ranges.

Writing: every task writes gzip archives, one member per record, into the given folder and
returns their names and lengths; files of failed or repeated attempts are in no list and
never read. Of equal payloads one record holds the payload, the others refer to it.

Reading: archives are cut into byte ranges. A task takes every place in its range that
looks like the start of a member as a candidate and finds where its successor would start,
reading beyond the range where needed. A payload may hold bytes that look like a member, so
only candidates that the chain of successors reaches from the start of the file are
records: candidates of one range are chained in place to the first offset beyond it, and
pointer jumping over these exits finds where each range is entered, in as many rounds as
the logarithm of the ranges of a file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsieve.session import shared_dir, small_side, written

FILE_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
STEP = 1 << 16
LEAST_PAYLOAD = 1000
MAGIC = b"\x1f\x8b\x08"
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
MANIFEST = "file string, length long, records long"
CANDIDATE = (
    "file string, range long, offset long, successor long, exit long, page_id long, url string, record_type string, "
    "refers_to long, payload_bytes long, payload_digest string"
)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


# Writing


def record(page_id, url, payload: bytes, refers_to) -> bytes:
    """One WARC record: a response with its payload, or a revisit of another page's."""
    digest = hashlib.sha1(payload)
    about = f"{page_id}:{digest.hexdigest()}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, about)}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(digest.digest()).decode(),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
        "X-Payload-Bytes": str(len(payload)),
    }
    if page_id is not None:
        fields["X-Page-Id"] = str(page_id)
    if refers_to is not None:
        other = uuid.uuid5(uuid.NAMESPACE_URL, f"{refers_to}:{digest.hexdigest()}")
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:uuid:{other}>", "X-Refers-To-Page": str(refers_to)}
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def revisits(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """page_id, digest, refers_to of the pages whose payload another page holds."""
    large = pages.filter(F.col("bytes") >= least).select("page_id", "digest")
    groups = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    both = large.join(groups.drop("n"), "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return both.distinct()


def write_archives(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Archives of all rows; file, length and records of each archive, already written.

    page_id is a long. NULL html is an empty payload. Equal payloads of at least
    LEAST_PAYLOAD bytes are held by the largest page_id; rows equal in id and payload all
    hold it. A NULL page_id refers to the holder if there is one. No rows, no archives.
    """
    plain = pages.select(
        pages[page_id].cast("long").alias("page_id"), pages[url].alias("url"), F.coalesce(pages[html], F.lit("")).alias("html")
    )
    marked = plain.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html")})
    again = written(revisits(marked.select("page_id", "digest", "bytes")), "revisits").toDF("r_digest", "r_id", "refers_to")
    same = marked["page_id"].eqNullSafe(F.col("r_id")) & (marked["digest"] == F.col("r_digest"))
    rows = marked.join(small_side(again), same, "left").select("page_id", "url", "html", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        made, out, name, size, n = [], None, "", 0, 0

        def close():
            if out:
                out.close()
                made.append((name, size, n))

        for batch in batches:
            for page in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")]):
                data = member(record(page[0], page[1], page[2].encode(), page[3]))
                if out is None or size + len(data) > file_bytes:
                    close()
                    name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{len(made):04d}.warc.gz"
                    out, size, n = store.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                out.write(data)
                size, n = size + len(data), n + 1
        close()
        if made:
            names, sizes, counts = zip(*made)
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{x}" for x in names]), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                names=["file", "length", "records"],
            )

    return written(rows.mapInArrow(write, MANIFEST), "archives")


# Reading


class Window:
    """Bytes of a file from an offset on, read as far as needed."""

    def __init__(self, source, start: int, length: int):
        self.source, self.start, self.length, self.data = source, start, length, b""

    def need(self, end: int) -> None:
        end = min(end, self.length)
        have = self.start + len(self.data)
        if end > have:
            self.source.seek(have)
            self.data += self.source.read(max(end - have, min(STEP, self.length - have)))

    def inflate(self, offset: int) -> tuple[bytes, int] | None:
        """Content of the member at offset and where the next one starts; None if there
        is no whole member."""
        unpacker, out, at = zlib.decompressobj(31), [], offset
        try:
            while not unpacker.eof:
                if at >= self.length:
                    return None
                self.need(at + STEP)
                chunk = self.data[at - self.start : at - self.start + STEP]
                out.append(unpacker.decompress(chunk))
                at += len(chunk)
        except zlib.error:
            return None
        return b"".join(out), at - len(unpacker.unused_data)


def parse(data: bytes) -> dict | None:
    """Fields of a WARC record, with its block; None if it is not a whole one."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(b"WARC/"):
        return None
    pairs = [line.decode("utf-8", "replace").partition(":") for line in lines[1:]]
    fields = {k.strip().lower(): v.strip() for k, _, v in pairs}
    size = fields.get("content-length", "")
    if not size.isdigit() or len(rest) != int(size) + 4 or rest[-4:] != b"\r\n\r\n":
        return None
    return fields | {"block": rest[:-4]}


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d+", text) else None


def content(fields: dict) -> tuple:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest of a record.

    A response's payload is measured; a revisit's is as its header says.
    """
    kind = fields.get("warc-type")
    if kind == "revisit":
        size = _number(fields.get("x-payload-bytes"))
        named = fields.get("warc-payload-digest", "").partition(":")[2]
        digest = base64.b32decode(named).hex() if named else None
    else:
        payload = fields["block"].partition(b"\r\n\r\n")[2]
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    return (
        _number(fields.get("x-page-id")), fields.get("warc-target-uri"), kind,
        _number(fields.get("x-refers-to-page")), size, digest,
    )


def range_candidates(source, length: int, start: int, end: int) -> list[tuple]:
    """(offset, successor, exit, content) of each whole member that starts in the range."""
    window = Window(source, start, length)
    window.need(end + len(MAGIC) - 1)
    found, at = [], window.data.find(MAGIC)
    while 0 <= at < end - start:
        got = window.inflate(start + at)
        if got:
            fields = parse(got[0])
            found.append((start + at, got[1], content(fields) if fields else (None,) * 6))
        at = window.data.find(MAGIC, at + 1)
    exits: dict[int, int] = {}
    for offset, successor, _ in reversed(found):
        exits[offset] = successor if successor >= end else exits.get(successor, -1)
    return [(offset, successor, exits[offset], what) for offset, successor, what in found]


def candidates(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Candidate records of all byte ranges; exit is -1 where a chain breaks."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    ranges = manifest.select("file", "length", F.explode(starts).alias("start"))
    n = max(1, manifest.agg(F.sum(F.ceil(F.col("length") / range_bytes))).first()[0] or 1)
    ranges = ranges.repartition(int(min(n, 100_000)), "file", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, length, start in zip(*[c.to_pylist() for c in batch.columns]):
                store, path = _open(file)
                with store.open_input_file(path) as source:
                    found = range_candidates(source, length, start, min(start + range_bytes, length))
                rows = [(file, start, o, s, e, *what) for o, s, e, what in found]
                columns = list(zip(*rows)) if rows else [()] * 11
                kinds = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in CANDIDATE.split(", ")]
                )

    return ranges.mapInArrow(run, CANDIDATE)


def entries(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file, offset) where the chain from the start of each file enters a range."""
    reached = manifest.select("file", F.lit(0).cast("long").alias("offset"))
    exits = found.filter("exit >= 0").select("file", "offset", "exit")
    steps = exits.join(exits.select("file", F.col("exit").alias("offset")).union(reached).distinct(), ["file", "offset"], "left_semi")
    steps = written(steps, "warc-steps")
    reached, n = written(reached, "warc-entries"), -1
    while True:
        further = reached.join(steps, ["file", "offset"]).select("file", F.col("exit").alias("offset"))
        reached = written(reached.union(further).distinct(), "warc-entries")
        grown = reached.count()
        if grown == n:
            return reached
        n = grown
        next_ = steps.select("file", F.col("offset").alias("exit"), F.col("exit").alias("beyond"))
        steps = written(steps.join(next_, ["file", "exit"]).select("file", "offset", F.col("beyond").alias("exit")), "warc-steps")


def _walk(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """Offsets of one range that its entry leads to."""
    successor = dict(zip(group["offset"], group["successor"]))
    out = []
    for at in group.loc[group["entry"], "offset"]:
        while at in successor:
            out.append(at)
            at = successor[at]
    return pd.DataFrame({"file": key[0], "offset": sorted(set(out))}).astype({"offset": "int64"})


def read_archives(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records of the archives: file, offset, page_id, url, record_type, refers_to,
    payload_bytes and payload_digest (SHA-1, hex) of the full payload.

    Members that hold no WARC record are passed over; a damaged member ends its file.
    """
    found = written(candidates(manifest, range_bytes), "warc-candidates")
    entered = entries(found, manifest).withColumn("entry", F.lit(True))
    links = found.select("file", "range", "offset", "successor").join(entered, ["file", "offset"], "left")
    links = links.select("file", "range", "offset", "successor", F.coalesce("entry", F.lit(False)).alias("entry"))
    chained = links.groupBy("file", "range").applyInPandas(_walk, "file string, offset long")
    records = found.filter("record_type IS NOT NULL").join(chained, ["file", "offset"], "left_semi")
    return records.drop("range", "successor", "exit")


def new_folder(spark: SparkSession) -> str:
    """A new folder for archives in the cluster's shared folder."""
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
