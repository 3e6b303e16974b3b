"""Exact deduplication by Grace hashing: records are partitioned by the hash of their content
until what a task gets fits an open-addressing table that compares whole contents.

Three passes. First each task of the scan puts its texts through a bounded table, so that
copies within a task leave as one record with their count, however large a group is; every
row gets the number of its record. Then the records are partitioned by hash, so many ways
that a bucket should fit; what does not fit is spilled, with the bucket's table full, to a
table in the shared folder that the next level partitions by other bits, until nothing is
left over. Last the rows look up what became of their record, which are few rows for each
key, as a record belongs to one task of the scan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import arrow_batches, drop, text_or_empty, written

#: Characters that do not count when texts are compared.
SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of distinct contents that a table takes; a task holds one table.
TABLE_BYTES = 64 << 20
#: Bytes of one Arrow batch that a task gives back.
BATCH_BYTES = 4 << 20


class OpenTable:
    """Distinct contents by open addressing: a slot holds the number of an entry, entries are
    probed from their hash on, one slot after another, and contents are compared whole."""

    def __init__(self, limit: int = TABLE_BYTES):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(64, -1, np.int32)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def _place(self, h: int, content: bytes | None) -> int:
        """The slot of ``content``, or the empty one where its probe ends."""
        mask, at = len(self.slots) - 1, h & (len(self.slots) - 1)
        while (e := int(self.slots[at])) >= 0:
            if content is not None and self.hashes[e] == h and self.contents[e] == content:
                break
            at = (at + 1) & mask
        return at

    def find(self, h: int, content: bytes) -> int:
        """The entry of ``content``, -1 if there is none."""
        return int(self.slots[self._place(h, content)])

    @property
    def full(self) -> bool:
        return self.bytes >= self.limit

    def add(self, h: int, content: bytes) -> int:
        """A new entry; the table grows at two thirds."""
        e = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + 100
        if 3 * e >= 2 * len(self.slots):
            self.slots = np.full(2 * len(self.slots), -1, np.int32)
            for k, x in enumerate(self.hashes[:-1]):
                self.slots[self._place(x, None)] = k
        self.slots[self._place(h, content)] = e
        return e


def _hash(content: bytes) -> int:
    return xxhash.xxh3_64_intdigest(content)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


#: What a record has besides its content: rows, and of its best row the code points, doc_id
#: and number; the best has the most code points, then the smallest id, nulls last.
_RECORD = "_cm_rec long, _cm_h long, _cm_text binary, _cm_rows long, _cm_n long, _cm_best long, _cm_row long"
_NO_ID = np.iinfo(np.int64).max
#: Numbers below this are for the records and rows of one task of the scan.
_OWN = 1 << 34


def _scanned(extra: T.StructType, limit: int):
    """For mapInArrow over (_cm_text, _cm_n, _cm_id, further columns): a row of each input row
    with its record's number, and the records whenever the table is full and at the end."""
    schema = to_arrow_schema(T.StructType([*T._parse_datatype_string(_RECORD), *extra]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, base = OpenTable(limit), TaskContext.get().partitionId() * _OWN
        rows: list[int] = []
        best: list[tuple] = []
        made, row = 0, 0

        def records() -> Iterator[pa.RecordBatch]:
            nonlocal made
            start, size = 0, 0
            for e, c in enumerate(table.contents):
                size += len(c) + 100
                if size >= BATCH_BYTES or e == len(table.contents) - 1:
                    part = slice(start, e + 1)
                    b = best[part]
                    cols = [range(base + made + start, base + made + e + 1), map(_signed, table.hashes[part]), table.contents[part], rows[part], [-x[0] for x in b], [x[1] for x in b], [x[2] for x in b]]
                    cols = [pa.array(list(c), f.type) for c, f in zip(cols, schema)]
                    yield pa.record_batch([*cols, *(pa.nulls(e + 1 - start, f.type) for f in list(schema)[7:])], schema=schema)
                    start, size = e + 1, 0
            made += len(table.contents)
            table.clear()
            rows.clear()
            best.clear()

        for batch in batches:
            texts, points, ids = (batch.column(k) for k in range(3))
            done = 0
            for k in range(batch.num_rows + 1):
                if k == batch.num_rows or table.full:
                    if k > done:  # rows go out before the records of their numbers are cleared
                        own = slice(done, k)
                        yield pa.record_batch([pa.array(rec[own], pa.int64()), *(pa.nulls(k - done, f.type) for f in list(schema)[1:5]), ids.slice(done, k - done).cast(pa.int64()), pa.array(range(base + row - (k - done), base + row), pa.int64()), *(batch.column(3 + j).slice(done, k - done) for j in range(len(extra)))], schema=schema)
                        done = k
                    if table.full:
                        yield from records()
                if k == batch.num_rows:
                    break
                if k == 0:
                    rec: list[int] = []
                content = texts[k].as_py().encode().translate(None, SPACES)
                h = _hash(content)
                e = table.find(h, content)
                here = (-points[k].as_py(), _NO_ID if (i := ids[k].as_py()) is None else i, base + row)
                if e < 0:
                    e = table.add(h, content)
                    rows.append(1)
                    best.append(here)
                else:
                    rows[e] += 1
                    best[e] = min(best[e], here)
                rec.append(base + made + e)
                row += 1
        yield from records()

    return run


_ANSWER = "_cm_rec long, _cm_keep long, _cm_keep_row long, group_size long, text_sha256 string"


def _bucket(limit: int):
    """For mapInArrow over the records of a bucket: an answer for each record whose content
    is in the table, and those that found it full, as they are."""
    schema = to_arrow_schema(T._parse_datatype_string(f"{_ANSWER}, spilled boolean, {', '.join(x for x in _RECORD.split(', ')[1:])}"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = OpenTable(limit)
        rows: list[int] = []
        best: list[tuple] = []
        recs: list[int] = []
        entries: list[int] = []
        for batch in batches:
            left = []
            hs, texts = batch.column(1).to_pylist(), batch.column(2)
            nums = [batch.column(k).to_pylist() for k in (0, 3, 4, 5, 6)]
            for k, (h, rec, n, points, id_, row) in enumerate(zip(hs, *nums)):
                h &= (1 << 64) - 1
                content = texts[k].as_py()
                e = table.find(h, content)
                if e < 0:
                    if table.full:
                        left.append(k)
                        continue
                    e = table.add(h, content)
                    rows.append(0)
                    best.append((0, _NO_ID, _NO_ID))
                rows[e] += n
                best[e] = min(best[e], (-points, id_, row))
                recs.append(rec)
                entries.append(e)
            if left:
                part = batch.take(pa.array(left))
                none = [pa.nulls(len(left), f.type) for f in list(schema)[1:5]]
                yield pa.record_batch([part.column(0), *none, pa.array([True] * len(left)), *part.columns[1:]], schema=schema)
        sha = [hashlib.sha256(c).hexdigest() for c in table.contents]
        for a in range(0, len(recs), 10_000):
            es = entries[a : a + 10_000]
            cols = [recs[a : a + 10_000], [best[e][1] for e in es], [best[e][2] for e in es], [rows[e] for e in es], [sha[e] for e in es], [False] * len(es)]
            cols = [pa.array(c, f.type) for c, f in zip(cols, schema)]
            yield pa.record_batch([*cols, *(pa.nulls(len(es), f.type) for f in list(schema)[6:])], schema=schema)

    return run


def _groups(docs: DataFrame, extra: list[str], limit: int) -> DataFrame:
    """``extra`` columns of each row, with _cm_id, _cm_keep, kept, group_size and text_sha256."""
    spark = docs.sparkSession
    arrow_batches(spark)
    slim = docs.select(text_or_empty().alias("_cm_text"), F.length(text_or_empty()).cast("long").alias("_cm_n"), F.col("doc_id").cast("long").alias("_cm_id"), *(F.col(c).alias(f"_cm_x{k}") for k, c in enumerate(extra)))
    more = T.StructType([T.StructField(f.name, f.dataType) for f in slim.schema.fields[3:]])
    scanned = written(slim.mapInArrow(_scanned(more, limit), T.StructType([*T._parse_datatype_string(_RECORD), *more])), "records")
    records = scanned.where("_cm_text is not null").select([f.name for f in T._parse_datatype_string(_RECORD)])
    answers, spilled, level = None, records, 0
    shape = _bucket(limit)
    while True:
        size = spilled.agg(F.sum(F.octet_length("_cm_text") + 100)).first()[0]
        if not size:
            break
        ways = max(1, -(-3 * size // (2 * limit)))
        parted = spilled.repartition(int(ways), F.xxhash64("_cm_h", F.lit(level)))
        got = written(parted.mapInArrow(shape, f"{_ANSWER}, spilled boolean, {', '.join(_RECORD.split(', ')[1:])}"), f"level{level}")
        found = got.where("not spilled").select([f.name for f in T._parse_datatype_string(_ANSWER)])
        answers = found if answers is None else answers.unionByName(found)
        spilled, level = got.where("spilled").select([f.name for f in T._parse_datatype_string(_RECORD)]), level + 1
    rows = scanned.where("_cm_text is null").select("_cm_rec", F.col("_cm_best").alias("_cm_id"), "_cm_row", *more.names)
    if answers is None:
        answers = spark.createDataFrame([], _ANSWER)
    out = rows.join(answers, "_cm_rec")
    keep = F.when(F.col("_cm_keep") != int(_NO_ID), F.col("_cm_keep"))
    return out.select(*more.names, "_cm_id", keep.alias("_cm_keep"), "group_size", (F.col("_cm_row") == F.col("_cm_keep_row")).alias("kept"), "text_sha256")


def exact_groups(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Groups of documents whose texts are identical once every character of
    ``[\\x20\\x09-\\x0D]`` is deleted, by Grace hash deduplication; whole contents are compared.

    Returns one row for each row of ``docs``: doc_id, keep_id (doc_id of the row that stays:
    of a group that with the most code points in its text as it was, then with the smallest
    doc_id), group_size, kept, text_sha256 (lower-case hex, of the compared text in UTF-8).

    A null text is an empty one; empty and blank texts are one group. A null id comes after
    all others; where such a row stays keep_id is null. Of rows that repeat an id with texts as
    long one stays. An empty table gives an empty result. ``table_bytes`` bounds the contents
    that a task holds; a longer text is held alone.
    """
    return _groups(docs, [], table_bytes).select(F.col("_cm_id").alias("doc_id"), F.col("_cm_keep").alias("keep_id"), "group_size", "kept", "text_sha256")


def drop_exact(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns as they were; one row of each
    group of :func:`exact_groups`."""
    out = _groups(docs, docs.columns, table_bytes).where("kept")
    return out.select(*(F.col(f"_cm_x{k}").alias(c) for k, c in enumerate(docs.columns)))
