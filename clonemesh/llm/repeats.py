"""Word runs that repeat across documents, found from sampled anchors in three passes.

Rows are dealt by a hash of id and text into batches of a few megabytes. Pass one sends the
anchors of each batch (each hash once a batch) as rows, which are sorted by the shuffle so
that equal ones are neighbours; those that stand beside another go back to their batches.
Pass two extends: every window of ``size`` words round a repeated anchor is hashed (to 96
bits), and the windows of each batch (each once, with its smallest and largest document)
are sorted and compared in the same way. Pass three applies the answer to the texts. A
hash sends at most one row from each batch however many documents hold it, so a passage
shared by a third of all documents makes no hot task; no pair of documents is ever formed, no
row is dropped, and rows shuffled grow in proportion to the input.

A document without an id (null) counts as the last of all. Rows of one id are one document.
A batch, and so any single text, is held whole in a worker with some 60 bytes a word of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import release, shuffle_partitions, text_or_empty, written
from .scan import U, Words, mix, rolling, run_starts, word_rows, words

NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Rule:
    """anchors(words) gives (hashes, word positions); an anchor at p stands for windows of
    ``size`` words that start at p - reach to p. With ``depth`` the anchors are suffixes that
    are sorted by their words, up to so many of them."""

    size: int
    reach: int
    anchors: Callable[[Words, int], tuple[np.ndarray, np.ndarray]]
    depth: int = 0


#: Differences of {1, 2, 4} modulo 7 are all residues, so of any two runs of 13 words there
#: is an offset under 7 at which both are at a cover position, with 7 words left.
COVER, PERIOD = (1, 2, 4), 7


def cover_anchors(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of size - 6 words that start at cover positions of their text."""
    n = size - PERIOD + 1
    ok = run_starts(w.first, n)
    at = np.arange(len(ok)) - w.first[:-1][word_rows(w.first)[: len(ok)]] if len(ok) else np.zeros(0, np.int64)
    p = np.flatnonzero(ok & np.isin(at % PERIOD, COVER))
    return rolling(w.h, n)[p], p


#: Suffixes are kept at minimisers: of each SPREAD neighbouring suffixes the one whose first
#: SEED words have the smallest hash.
SPREAD, SEED = 12, 13


def minimiser_anchors(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sparse suffix array's entries: at minimisers, the hash of the size - SPREAD + 1
    words that any run of ``size`` words leaves to its first minimiser."""
    ok = run_starts(w.first, size)
    if not ok.any():
        return np.zeros(0, U), np.zeros(0, np.int64)
    g, n = rolling(w.h, SEED), len(ok)
    low = g[:n].copy()
    for k in range(1, SPREAD):
        np.minimum(low, g[k : n + k], out=low)
    at = np.zeros(n, np.int64)
    for k in range(SPREAD - 1, -1, -1):  # the leftmost of equal ones stays
        np.copyto(at, k, where=g[k : n + k] == low)
    p = np.unique((np.arange(n) + at)[ok])
    return rolling(w.h, size - SPREAD + 1)[p], p


def suffix_array(codes: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes of ``codes`` that start at ``at`` by their first ``depth``
    codes, and the length of the prefix that each has in common with the one before it. Word
    by word, only suffixes that are still tied are sorted on."""
    n = len(at)
    order, common = np.arange(n), np.zeros(n, np.int64)
    group = np.zeros(n, np.int64)  # of each place of the order: the first place of its ties
    todo = np.arange(n)
    for d in range(depth):
        if not len(todo):
            break
        key = codes[at[order[todo]] + d]
        o = np.lexsort((key, group[todo]))
        order[todo] = order[todo[o]]
        key, was = key[o], group[todo]
        edge = np.r_[True, (key[1:] != key[:-1]) | (was[1:] != was[:-1])]
        new = edge & np.r_[False, was[1:] == was[:-1]]
        common[todo[new]] = d
        group[todo] = todo[np.maximum.accumulate(np.where(edge, np.arange(len(todo)), 0))]
        tied = ~edge | np.r_[~edge[1:], False]
        todo = todo[tied]
    if len(todo):
        common[todo[group[todo] != todo]] = depth
    return order, common


def _runs(first: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of runs; the smallest and the largest document of each."""
    st = np.flatnonzero(first)
    return st, np.minimum.reduceat(doc, st) if len(st) else doc, np.maximum.reduceat(doc, st) if len(st) else doc


def _changes(h: np.ndarray) -> np.ndarray:
    return np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)


class _Batch:
    """The documents of a batch, and what both first passes find."""

    def __init__(self, t: pa.Table, rule: Rule):
        self.rule, self.ids = rule, t.column("_cm_id").to_numpy()
        self.blocks = list(words(t.column("text")))

    def docs(self, w: Words, at: np.ndarray) -> np.ndarray:
        return self.ids[w.r0 + word_rows(w.first)[at]]

    def anchors(self) -> None:
        self.found = [self.rule.anchors(w, self.rule.size) for w in self.blocks]

    def entries(self) -> list[np.ndarray]:
        """Of each distinct anchor: its first two words (suffixes only), hash, and whether
        several documents have it."""
        h = np.concatenate([np.zeros(0, U), *(h for h, _ in self.found)])
        doc = np.concatenate([np.zeros(0, np.int64), *(self.docs(w, p) for w, (_, p) in zip(self.blocks, self.found))])
        if not self.rule.depth:
            o = np.argsort(h, kind="stable")
            st, low, high = _runs(_changes(h[o]), doc[o])
            return [h[o][st].view(np.int64), low < high]
        codes = np.concatenate([np.zeros(0, U), *(w.h for w in self.blocks)])
        base = np.cumsum([0, *(len(w.h) for w in self.blocks)])
        at = np.concatenate([np.zeros(0, np.int64), *(p + k for (_, p), k in zip(self.found, base))])
        o, common = suffix_array(codes, at, self.rule.depth)
        first = common < self.rule.depth
        first[:1] = True
        st, low, high = _runs(first, doc[o])
        start = at[o[st]]
        return [codes[start].view(np.int64), codes[start + 1].view(np.int64), h[o[st]].view(np.int64), low < high]

    def windows(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both hashes and the document of every window that extends an anchor in
        ``repeated`` (sorted hashes of those that other documents share)."""
        size, out = self.rule.size, []
        for w, (h, p) in zip(self.blocks, self.found):
            ok = run_starts(w.first, size)
            if len(repeated) and len(ok) and len(p):
                k = np.minimum(np.searchsorted(repeated, h), len(repeated) - 1)
                hit = p[repeated[k] == h]
                d = np.zeros(len(w.h) + 1, np.int32)
                np.add.at(d, np.maximum(0, hit - self.rule.reach), 1)
                np.add.at(d, hit + 1, -1)
                at = np.flatnonzero(ok & (np.cumsum(d)[: len(ok)] > 0))
                if len(at):
                    out.append((rolling(w.h, size)[at], self._check(w)[at], self.docs(w, at)))
        return tuple(np.concatenate([np.zeros(0, k), *(x[i] for x in out)]) for i, k in enumerate((U, np.int64, np.int64)))

    def _check(self, w: Words) -> np.ndarray:
        """32 more bits of each window's hash."""
        return (rolling(mix(w.h + U(1)), self.rule.size) >> U(33)).astype(np.int64)

    def covered(self, h: np.ndarray, g: np.ndarray, low: np.ndarray, later: bool) -> list[np.ndarray]:
        """For each block a mask of words in windows that are among (h, g), sorted by h, which
        several documents have; with ``later`` only if one with a smaller id (low) does."""
        out = []
        for w in self.blocks:
            at = np.flatnonzero(run_starts(w.first, self.rule.size))
            if len(at) and len(h):
                wh = rolling(w.h, self.rule.size)[at]
                k = np.minimum(np.searchsorted(h, wh), len(h) - 1)
                hit = h[k] == wh
                at, k = at[hit], k[hit]
                if len(at):
                    at = at[(g[k] == self._check(w)[at]) & ((low[k] < self.docs(w, at)) if later else True)]
            else:
                at = at[:0]
            d = np.zeros(len(w.h) + 1, np.int32)
            d[at] += 1
            d[at + self.rule.size] -= 1
            out.append(np.cumsum(d)[:-1] > 0)
        return out


def _reply(t: pa.Table) -> list[np.ndarray]:
    """The other columns of the answers, sorted by their first, the hash."""
    h = t.column("_cm_h").to_numpy().view(U)
    o = np.argsort(h, kind="stable")
    return [h[o], *(t.column(c).to_numpy()[o].astype(np.int64) for c in t.column_names if c in ("_cm_g", "_cm_low"))]


def repeated_runs(docs: DataFrame, rule: Rule, finish: Callable[[pa.Table, "Covered"], pa.Table], schema: T.StructType, later: bool, batch_bytes: int = 4 << 20) -> DataFrame:
    """Find the words covered by windows that occur in several documents, with ``later`` only
    those in documents after the first, then give each batch with its masks to ``finish``."""
    spark = docs.sparkSession
    docs = docs.withColumn("_cm_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))))
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = shuffle_partitions(spark)
    batches = int(max(1, -(-total // batch_bytes), min(2 * parts, total >> 18)))
    docs = docs.withColumn("_cm_batch", F.pmod(F.xxhash64("_cm_id", "text"), F.lit(batches)).cast("int"))
    slim = docs.select("_cm_batch", "_cm_id", text_or_empty().alias("text"))
    lead = ["k1", "k2"] if rule.depth else []

    def of(t: pa.Table) -> _Batch:
        b = _Batch(t, rule)
        b.anchors()
        return b

    def batch(t: pa.Table, n: int) -> pa.Array:
        return pa.array(np.full(n, t.column("_cm_batch")[0].as_py(), np.int32))

    def first(t: pa.Table) -> pa.Table:
        cols = of(t).entries()
        return pa.table([*(pa.array(c) for c in cols), batch(t, len(cols[0]))], names=[*lead, "h", "multi", "batch"])

    def second(t: pa.Table, replies: pa.Table) -> pa.Table:
        names = ["h", "g", "low", "more", "batch"]
        if not t.num_rows:
            return pa.table([pa.array([], x) for x in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())], names=names)
        h, g, doc = of(t).windows(_reply(replies)[0])
        o = np.lexsort((g, h))
        h, g = h[o], g[o]
        st, low, high = _runs(_changes(h) | _changes(g), doc[o])
        return pa.table([pa.array(h[st].view(np.int64)), pa.array(g[st], pa.int32()), pa.array(low), pa.array(high - low), batch(t, len(st))], names=names)

    def third(t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table([[]] * len(empty), schema=empty)
        return finish(t, Covered(_Batch(t, rule), *_reply(replies)))

    empty = to_arrow_schema(schema)
    one = slim.groupBy("_cm_batch").applyInArrow(first, "".join(f"{c} long, " for c in lead) + "h long, multi boolean, batch int")
    if rule.depth:  # the batches' arrays become one, in the order of their words
        one = written(one, "suffixes").repartitionByRange(*lead, "h")
    same = Window.partitionBy(*lead, "h")
    one = one.withColumns({"n": F.count("*").over(same), "any": F.max("multi").over(same)}).where("n > 1 or any")
    one = written(one.select(F.col("batch").alias("_cm_batch"), F.col("h").alias("_cm_h")), "anchors")
    release(spark)
    two = slim.groupBy("_cm_batch").cogroup(one.groupBy("_cm_batch")).applyInArrow(second, "h long, g int, low long, more long, batch int")
    same = Window.partitionBy("h", "g")
    high = F.col("low") + F.col("more")
    two = two.withColumns({"high": high, "least": F.min("low").over(same), "most": F.max(high).over(same)})
    # where only later documents matter, a batch with just the first one needs no answer
    two = two.where("least < high" if later else "least < most")
    two = written(two.select(F.col("batch").alias("_cm_batch"), F.col("h").alias("_cm_h"), F.col("g").alias("_cm_g"), F.col("least").alias("_cm_low")), "windows")
    release(spark, one)
    return docs.groupBy("_cm_batch").cogroup(two.groupBy("_cm_batch")).applyInArrow(third, schema)


class Covered:
    """Masks of words of a batch, by block of texts."""

    def __init__(self, batch: _Batch, h: np.ndarray, g: np.ndarray, low: np.ndarray):
        self.batch, self.known, self.blocks = batch, (h, g, low), batch.blocks

    def later(self) -> list[np.ndarray]:
        """Words in windows that also start in a document with a smaller id."""
        return self.batch.covered(*self.known, True)

    def shared(self) -> list[np.ndarray]:
        """Words in windows that another document has, too."""
        return self.batch.covered(*self.known, False)


def remove_repeats(docs: DataFrame, size: int = 13, keep_text: bool = False) -> DataFrame:
    """Difference-cover substring dedup.

    Every word covered by a window of ``size`` words that also starts in a document with a
    smaller ``doc_id`` is removed; windows are judged on the input. Returns doc_id, n_words,
    n_removed, kept_sha256 (of the kept words joined by one space); with ``keep_text``
    instead all columns of ``docs``, where ``text`` is as it was if nothing was removed and
    otherwise the kept words joined by one space, and ``n_chars`` follows it.

    A null text has no words. A null id counts as the last of all; rows that repeat an id
    are one document and remove nothing from each other. Texts of fewer than ``size`` words
    stay whole. An empty table gives an empty result. ``size`` is at least 7.
    """
    if size < PERIOD:
        raise ValueError(f"size must be at least {PERIOD}")
    if keep_text:
        schema = docs.schema
    else:
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
        docs = docs.select("doc_id", "text")

    def finish(t: pa.Table, c: Covered) -> pa.Table:
        n, gone, sha, texts = [], [], [], []
        col = t.column("text")
        for w, mask in zip(c.blocks, c.later()):
            size_of = np.diff(np.r_[0, np.cumsum(mask)][w.first])
            raw = [x.as_py() or "" for x in col.slice(w.r0, w.r1 - w.r0)]
            for i, text in enumerate(raw):
                ws, k = text.encode().split(), int(size_of[i])
                if k:
                    ws = compress(ws, ~mask[w.first[i] : w.first[i + 1]])
                if keep_text:
                    texts.append(b" ".join(ws).decode() if k else None)
                else:
                    sha.append(hashlib.sha256(b" ".join(ws)).hexdigest())
            n.append(w.counts())
            gone.append(size_of)
        if not keep_text:
            return pa.table([t.column("doc_id").cast(pa.int64()), pa.array(np.concatenate(n), pa.int64()), pa.array(np.concatenate(gone), pa.int64()), pa.array(sha, pa.string())], names=schema.names)
        cols = {f.name: t.column(f.name) for f in schema}
        was = t.column("text").to_pylist()
        now = [a if b is None else b for a, b in zip(was, texts)]
        cols["text"] = pa.array(now, cols["text"].type)
        if "n_chars" in cols:
            cols["n_chars"] = pa.array([a if b is None else len(b) for a, b in zip(cols["n_chars"].to_pylist(), texts)], cols["n_chars"].type)
        return pa.table(cols)

    return repeated_runs(docs, Rule(size, PERIOD - 1, cover_anchors), finish, schema, True)


def repeated_spans(docs: DataFrame, size: int = 50) -> DataFrame:
    """Sparse-suffix-array dedup: the maximal runs of words of each document that are made
    of windows of ``size`` words which another document has, too.

    Suffixes are kept at minimisers only: of 12 neighbouring ones that whose first 13 words
    have the smallest hash. Each batch sorts its suffixes word by word (:func:`suffix_array`)
    and takes the common prefixes of neighbours; runs of neighbours with size - 11 words in
    common are one entry. The batches' arrays are merged by range, in the order of the first
    two words and, within these, of a hash of the size - 11, and neighbours are compared again.
    Matches are extended by up to 11 words to the left and as many to the right, so that each
    window of ``size`` words round them is decided. Returns one row for each span:
    doc_id, start_word, end_word (exclusive), n_words, n_repeated (words of the document in
    any span), first boolean (no word of the span is in such a window of a document with a
    smaller id, so this copy can stay), span_sha256 (of the words joined by one space).

    Documents that share nothing give no row. A null text has no words; a null id is the last
    of all; rows that repeat an id are one document. An empty table gives no rows.
    """
    if size < SPREAD + SEED:
        raise ValueError(f"size must be at least {SPREAD + SEED}")
    names = ("doc_id", "start_word", "end_word", "n_words", "n_repeated")
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in names), T.StructField("first", T.BooleanType()), T.StructField("span_sha256", T.StringType())])

    def finish(t: pa.Table, c: Covered) -> pa.Table:
        rows, ids = [], t.column("doc_id").to_pylist()
        for w, mask, later in zip(c.blocks, c.shared(), c.later()):
            edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
            starts, ends = edge[::2], edge[1::2]
            cut = np.unique(np.r_[starts, w.first[(w.first > 0) & (w.first < len(mask))]]) if len(starts) else starts
            lo = cut[mask[cut]] if len(cut) else cut
            stop = np.unique(np.r_[ends, w.first])
            hi = stop[np.searchsorted(stop, lo, "right")] if len(lo) else lo
            row = word_rows(w.first)
            seen = np.r_[0, np.cumsum(later)]
            per = np.diff(np.r_[0, np.cumsum(mask)][w.first])
            for a, b in zip(lo.tolist(), hi.tolist()):
                i = int(row[a])
                f = int(w.first[i])
                text = b" ".join(w.data[w.starts[a] : w.ends[b - 1]].tobytes().split())
                rows.append((ids[w.r0 + i], a - f, b - f, b - a, int(per[i]), bool(seen[b] == seen[a]), hashlib.sha256(text).hexdigest()))
        return pa.table([list(x) for x in zip(*rows)] or [[]] * 7, schema=pa.schema([*((x, pa.int64()) for x in names), ("first", pa.bool_()), ("span_sha256", pa.string())]))

    return repeated_runs(docs.select("doc_id", "text"), Rule(size, SPREAD - 1, minimiser_anchors, size - SPREAD + 1), finish, schema, False)
