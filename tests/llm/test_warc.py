from __future__ import annotations

import base64
import glob
import gzip
import hashlib
import io

from clonemesh.llm import warc

PAGES = "page_id long, url string, html string, data string, digest string"


def test_round_trip(spark, tmp_path):
    big = "".join(chr(97 + i % 26) for i in range(2_500_000))
    rows = [(1, "http://a b/", big), (2, None, None), (3, "u", ""), (4, "u", "é" * 5), (9, "u", "é" * 5), (7, "u", "é" * 5), (None, "u", "é" * 5), (8, "u", "line\r\n\r\nWARC/1.1\r\nx"), (8, "u", "other")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES).repartition(2)
    base = tmp_path.as_uri() + "/w"
    got = warc.round_trip(pages, base).collect()
    assert len(got) == len(rows) and all(r.verified for r in got)
    key = lambda r: (r[0] or 0, r[1], r[2])
    want = []
    last = {"": 3, "é" * 5: 9}
    for i, _, h in rows:
        h = h or ""
        to = last.get(h) if i is not None and last.get(h, i) != i else None
        want.append((i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "revisit" if to else "response", to))
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    assert next(r for r in got if r.page_id == 1).chunks == 3


def test_a_repeated_id_keeps_its_other_payload(spark, tmp_path):
    rows = [(8, "u", "shared"), (8, "u", "own"), (9, "u", "shared"), (9, "u", "other"), (7, "u", "other"), (7, "u", "shared")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = warc.round_trip(pages, tmp_path.as_uri()).collect()
    name = {base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(): h for _, _, h in rows}
    want = [(7, "other", "revisit", 9), (7, "shared", "revisit", 9), (8, "own", "response", None), (8, "shared", "revisit", 9), (9, "other", "response", None), (9, "shared", "response", None)]
    assert sorted((r.page_id, name[r.payload_digest], r.record_type, r.refers_to) for r in got) == want
    raw = b"".join(gzip.open(f).read() for f in glob.glob(f"{tmp_path}/*.warc.gz"))
    assert raw.count(b"\r\n\r\nown\r\n\r\n") == 1


def test_files_are_plain_archives(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "")], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, tmp_path.as_uri())
    (name,) = glob.glob(f"{tmp_path}/*.warc.gz")
    raw = gzip.open(name).read()
    assert raw.count(b"WARC/1.1\r\n") == 2 and b"\r\n\r\nabc\r\n\r\n" in raw
    got = [(h["page-id"], no, data, last) for h, no, data, last in warc.read_chunks(open(name, "rb"), 2)]
    assert got == [("1", 0, b"ab", False), ("1", 1, b"c", True), ("2", 0, b"", True)]


def test_smaller_payloads_are_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.round_trip(pages, tmp_path.as_uri(), min_bytes=5).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert warc.round_trip(pages.limit(0), tmp_path.as_uri()).count() == 0


def test_stream_in_small_pieces(tmp_path):
    body = b"WARC/1.1\r\nPage-ID: 1\r\nContent-Length: 9\r\n\r\nH 1\r\n\r\nxy\r\n\r\n"
    z = gzip.compress(body[:20]) + gzip.compress(body[20:])
    s = warc._Stream(io.BytesIO(z), 3)
    assert s.line() == b"WARC/1.1"
    assert [d for _, _, d, _ in warc.read_chunks(io.BytesIO(z))] == [b"xy"]


def test_damaged_archives_and_digests_stop_the_run(spark, tmp_path):
    import pytest

    pages = spark.createDataFrame([(1, "u", "abc" * 50)], "page_id long, url string, html string").coalesce(1)
    files = warc.write_archives(pages, tmp_path.as_uri())
    (name,) = glob.glob(f"{tmp_path}/*.warc.gz")
    raw = gzip.open(name).read().replace(b"abcabc", b"abcabd", 1)
    with gzip.open(name, "wb") as f:
        f.write(raw)
    with pytest.raises(Exception, match="not what its header says"):
        warc.read_archives(files, tmp_path.as_uri()).collect()


def test_digests_go_on_over_batches(spark):
    import pyarrow as pa

    rows = [(1, 5, 9, 0, b"ab"), (1, 5, 9, 1, b"cde"), (None, 0, 3, 0, b""), (2, 1, 4, 0, b"x")]
    t = pa.table([list(c) for c in zip(*rows)], names=["page_id", "n_bytes", "hash", "chunk_no", "data"])
    got = [tuple(r.values()) for b in warc._digests(iter(t.to_batches(max_chunksize=1))) for r in b.to_pylist()]
    of = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    assert got == [(1, 5, 9, of(b"abcde")), (None, 0, 3, of(b"")), (2, 1, 4, of(b"x"))]
