"""Archives read back, chains of records, and what looks like a record but is none."""

import gzip
import hashlib
import zlib

from mailsieve.llm import warc as W


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_round_trip_over_many_ranges(spark, tmp_path):
    same = "<p>same</p>" * 200
    rows = [(i, f"http://h/{i}", f"<html>é🎉 {i} {'x' * (i * 37 % 900)}</html>") for i in range(150)]
    rows += [(200 + i, "http://s", same) for i in range(40)] + [(300, None, None), (301, "http://a b\r\nX: y", ""), (None, "http://n", same)]
    manifest = W.write_archives(pages(spark, rows).repartition(3), f"file://{tmp_path}/w", file_bytes=9000)
    assert manifest.count() > 5
    out = W.read_archives(manifest, range_bytes=700).collect()
    assert len(out) == len(rows)
    for r in out:
        html = next(h for i, _, h in rows if i == r.page_id) or ""
        data = html.encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        again = html == same and r.page_id != 239
        assert (r.record_type, r.refers_to) == (("revisit", 239) if again else ("response", None))


def stored(data: bytes) -> bytes:
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def test_magic_inside_a_payload_is_no_record(spark, tmp_path):
    inner = W.member(W.record(99, "http://inner", b"inner", None))
    body = b"x" * 500 + inner * 3 + b"\x1f\x8b\x08 broken" + inner
    members = [W.member(W.record(1, "http://1", b"one", None)), stored(W.record(2, "http://2", body, None)), gzip.compress(b"no record")]
    members += [W.member(W.record(i, f"http://{i}", b"p" * i, None)) for i in range(3, 60)]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(members))
    manifest = spark.createDataFrame([(str(path), path.stat().st_size, 0)], W.MANIFEST)
    for size in (64, 300, 1 << 20):
        found = W.candidates(manifest, size)
        assert found.filter("page_id = 99").count() == 4
        assert sorted(r.page_id for r in W.read_archives(manifest, size).collect()) == [1, 2, *range(3, 60)]


def test_damage_ends_the_file(spark, tmp_path):
    members = [W.member(W.record(i, f"http://{i}", b"p" * 50, None)) for i in range(5)]
    members[3] = members[3][:30] + b"\x00" * 20 + members[3][50:]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(members))
    manifest = spark.createDataFrame([(str(path), path.stat().st_size, 0)], W.MANIFEST)
    assert sorted(r.page_id for r in W.read_archives(manifest, 200).collect()) == [0, 1, 2]


def test_empty_and_equal_rows(spark, tmp_path):
    html = "y" * 1500
    none = pages(spark, [(1, "u", html)]).limit(0)
    assert W.read_archives(W.write_archives(none, f"file://{tmp_path}/e")).count() == 0
    rows = [(5, "u", html), (5, "u", html), (4, "v", html)]
    df = pages(spark, rows).selectExpr("*", "1 AS digest", "'x' AS refers_to")
    out = W.read_archives(W.write_archives(df, f"file://{tmp_path}/d")).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in out) == [(4, "revisit", 5), (5, "response", None), (5, "response", None)]
