"""WARC archives through chunked record tables.

A record's payload is a series of rows (record id, chunk number, bytes). Writing a task's
records streams these rows into one gzip member for each record; reading streams a file
back into such rows. Digests are carried from chunk to chunk: a first pass over the chunk
rows gives each payload's digest, which its header needs; the writer and the reader carry
their own and stop where they differ. No side holds more than a chunk of a payload
besides what the input table itself holds as a row.

Archives are in the shared folder, or another base, reached by ``pyarrow.fs`` on the
executors. A task writes under a name of its own attempt and reports the file; only
reported files are read, so a task that is run again leaves nothing that counts.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, new_path, written

CHUNK = 1 << 20
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, chunks int, verified boolean"


def _base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _payloads(pages: DataFrame) -> DataFrame:
    """page_id, uri and payload of each row, with its length and a hash that tell the rows of
    one page_id apart."""
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("uri"), html.alias("html"), F.octet_length(html).cast("long").alias("n_bytes"), F.xxhash64(html).alias("hash"))


def chunk_rows(rows: DataFrame, keep: tuple[str, ...], size: int = CHUNK, where: Column | None = None) -> DataFrame:
    """The columns ``keep``, chunk_no and data: a row for each chunk of each payload (an empty
    one has one), in order; data is null unless ``where``."""
    raw = F.encode("html", "UTF-8")
    last = F.greatest(F.lit(0), F.floor((F.octet_length("_cm_raw") - 1) / size).cast("int"))
    rows = rows.withColumn("_cm_raw", raw).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    data = F.substring(F.col("_cm_raw"), F.col("chunk_no") * size + 1, F.lit(size))
    return rows.select(*keep, F.col("chunk_no").cast("int"), (data if where is None else F.when(where, data)).alias("data"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each payload from its chunk rows; the last one goes on over batches."""
    key, sha, names = None, None, ["page_id", "n_bytes", "hash", "digest"]
    schema = pa.schema([(c, pa.int64()) for c in names[:3]] + [("digest", pa.string())])
    for b in batches:
        done = []
        for page_id, n, x, no, data in zip(*(c.to_pylist() for c in b.columns)):
            if no == 0:
                if sha is not None:
                    done.append((*key, _base32(sha.digest())))
                key, sha = (page_id, n, x), hashlib.sha1()
            sha.update(data)
        yield pa.record_batch([list(c) for c in zip(*done)] or [[]] * 4, schema=schema)
    if sha is not None:
        yield pa.record_batch([[x] for x in (*key, _base32(sha.digest()))], schema=schema)


def digests(pages: DataFrame) -> DataFrame:
    """page_id, n_bytes, hash and base32 SHA-1 of each payload."""
    keep = ("page_id", "n_bytes", "hash")
    return chunk_rows(_payloads(pages), keep).mapInArrow(_digests, "page_id long, n_bytes long, hash long, digest string")


def _header(fields: list[tuple[str, str]], length: int) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {length}\r\n\r\n").encode()


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page/{page_id}')}>"


_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _writer(base: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(base)
        name = f"{root}/{uuid.uuid4().hex}.warc.gz"
        out, member, count, open_, sha, due = None, None, 0, False, None, None

        def put(b: bytes) -> None:
            if z := member.compress(b):
                out.write(z)

        def end() -> None:
            if open_:
                if due is not None and _base32(sha.digest()) != due:
                    raise ValueError("a payload is not what its digest was made of")
                put(b"\r\n\r\n")
                out.write(member.flush())

        for b in batches:
            for page_id, uri, n, digest, response, no, data in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(name, compression=None, buffer_size=1 << 20)
                if no == 0:
                    end()
                    member, open_, count = zlib.compressobj(1, zlib.DEFLATED, 31), True, count + 1
                    sha, due = hashlib.sha1(), digest if response is None else None
                    fields = [("WARC-Type", "response" if response is None else "revisit"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", date)]
                    fields += [("WARC-Target-URI", "".join((uri or f"urn:page:{page_id}").split()))]
                    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Page-ID", "" if page_id is None else str(page_id)), ("Payload-Length", str(n))]
                    if response is not None:
                        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(response)), ("Refers-To-Page-ID", str(response))]
                    put(_header(fields, len(_HTTP) + (n if response is None else 0)) + _HTTP)
                if data is not None:
                    sha.update(data)
                    put(data)
        end()
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([name]), pa.array([count], pa.int64())], names=["file", "records"])

    return run


class _Stream:
    """Reads a gzip file of any number of members in pieces."""

    def __init__(self, raw, size: int = 1 << 18):
        self.raw, self.size, self.z, self.buf, self.rest = raw, size, zlib.decompressobj(31), bytearray(), b""

    def more(self) -> bool:
        while True:
            data = self.rest or self.raw.read(self.size)
            if not data:
                return False
            got = self.z.decompress(data, CHUNK)
            self.rest = self.z.unconsumed_tail
            if self.z.eof:
                self.rest, self.z = self.z.unused_data, zlib.decompressobj(31)
            if got:
                self.buf += got
                return True

    def line(self) -> bytes | None:
        """A line without its end; None at the end of the file."""
        seek = 0
        while (at := self.buf.find(b"\r\n", seek)) < 0:
            seek = max(0, len(self.buf) - 1)
            if not self.more():
                return None
        out = bytes(self.buf[:at])
        del self.buf[: at + 2]
        return out

    def take(self, n: int) -> bytes:
        if not self.buf and not self.more():
            raise EOFError("a record ends early")
        out = bytes(self.buf[:n])
        del self.buf[:n]
        return out


def read_chunks(raw, size: int = CHUNK) -> Iterator[tuple[dict, int, bytes, bool]]:
    """(header, chunk number, bytes, is it the last) for each chunk of each record."""
    s = _Stream(raw)
    while True:
        line = s.line()
        while line == b"":
            line = s.line()
        if line is None:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = {}
        while line := s.line():
            k, _, v = line.decode().partition(":")
            head[k.strip().lower()] = v.strip()
        left, no = int(head["content-length"]), 0
        while http := s.line():
            left -= len(http) + 2
        left -= 2
        part = bytearray()
        while left > 0:
            part += (got := s.take(min(left, size - len(part))))
            left -= len(got)
            if len(part) == size and left:
                yield head, no, bytes(part), False
                part, no = bytearray(), no + 1
        yield head, no, bytes(part), True


def _reader(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(base)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                with store.open_input_stream(name, compression=None) as raw:
                    sha, n = hashlib.sha1(), 0
                    for head, no, data, last in read_chunks(raw):
                        sha.update(data)
                        n += len(data)
                        if last:
                            kind, digest, size = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:"), int(head["payload-length"])
                            if kind != "revisit":  # what was read counts
                                if (_base32(sha.digest()), n) != (digest, size):
                                    raise ValueError(f"a record of {name} is not what its header says")
                                digest, size = _base32(sha.digest()), n
                            rows.append((int(head["page-id"]) if head["page-id"] else None, size, digest, kind, int(head["refers-to-page-id"]) if "refers-to-page-id" in head else None, no + 1, True))
                            sha, n = hashlib.sha1(), 0
                        if len(rows) >= 10_000:
                            yield _records(rows)
                            rows = []
                yield _records(rows)

    return run


def _records(rows: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunks", pa.int32()), ("verified", pa.bool_())])
    return pa.record_batch([list(c) for c in zip(*rows)] or [[]] * 7, schema=schema)


def write_archives(pages: DataFrame, base: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row of ``pages`` below ``base``; returns (file, records).

    Of records with equal payloads of at least ``min_bytes`` bytes the one with the largest
    page_id is a response and the others revisit it; smaller ones are all responses. A row
    without a page_id is always a response.
    """
    spark = pages.sparkSession
    arrow_batches(spark)
    known = written(digests(pages), "digests")
    groups = known.where(F.col("n_bytes") >= min_bytes).groupBy("digest", "n_bytes").agg(F.max("page_id").alias("last"), F.count("page_id").alias("copies")).where("copies > 1")
    # a page_id may repeat with another payload, so a decision holds for an id and a payload
    done = known.distinct().join(groups, ["digest", "n_bytes"], "left")
    done = done.select(F.col("page_id").alias("id"), F.col("n_bytes").alias("n"), F.col("hash").alias("x"), "digest", F.when(F.col("page_id") < F.col("last"), F.col("last")).alias("response_id"))
    rows = _payloads(pages)
    mine = rows["page_id"].eqNullSafe(done["id"]) & (rows["n_bytes"] == done["n"]) & (rows["hash"] == done["x"])
    rows = rows.join(done.hint("merge"), mine)
    chunks = chunk_rows(rows, ("page_id", "uri", "n_bytes", "digest", "response_id"), where=F.col("response_id").isNull())
    return written(chunks.mapInArrow(_writer(base, date), "file string, records long"), "manifest")


def read_archives(files: DataFrame, base: str) -> DataFrame:
    """One row for each record of the archives in ``files`` (column file): page_id,
    payload_bytes, payload_digest (of a response as read, of a revisit as its header says),
    record_type, refers_to, chunks, and verified (true: a response whose bytes differ in length
    or digest from its header is a ValueError)."""
    n = max(1, files.count())
    spread = files.repartition(min(n, 4096), "file") if n > 1 else files
    return spread.select("file").mapInArrow(_reader(base), _RECORD)


def round_trip(pages: DataFrame, base: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as WARC archives and read these back.

    A null html is an empty payload, which has a record like any other. Rows that repeat a
    page_id each have a record; of equal payloads those with the largest id are responses.
    A null page_id stays null, as a response. An empty table gives an empty result. Columns
    other than page_id, url and html are ignored.
    """
    base = base or new_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, base, min_bytes), base)
