"""Spelling variants: words one edit apart, by a positional q-gram inverted index.

The index is dealt out over tasks by the rarest grams of each word (those that one edit cannot
all destroy), so two words one edit apart meet in a block. Each block has its part of the index,
lists of words by length, place and gram. Of a word's lists under the limits of length and place
one edit leaves T at least; the T - 1 longest are set aside, the others are merged, and the words
that come up are verified letter by letter. Lists of many words are merged by one sort: a heap for
each word, in Python, took six times as long.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import drop
from .common import shuffle_partitions, written
from .importance import lower_ascii
from .scan import U, mix

#: Letters of a gram.
Q = 3
#: Words of a block, unless more blocks than SHARE would be beyond it.
BLOCK, SHARE = 1 << 15, 65536
#: Distinct grams that are broadcast with their counts (some 40 bytes each); three letters
#: of an alphabet of 90 make 729,000.
MOST_GRAMS = 1 << 20


def word_counts(docs: DataFrame, least: int = 7, repeats: int = 2, every: int = 31) -> DataFrame:
    """(word, n): the runs of letters of whole texts, A-Z lowered, with one letter deleted from
    those whose hash with the document's id ``every`` divides; words of ``least`` letters or
    more that occur ``repeats`` times or more.

    A null text has no words, a null id counts as an empty text in the hash."""
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit("[A-Za-z\\u00C0-\\u00FF]{%d,}" % least), F.lit(0))
    id_ = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    words = docs.select(id_.alias("id"), F.explode(runs).alias("run")).select("id", lower_ascii(F.col("run")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    words = words.select("run", h.alias("h"), (h % F.length("run")).cast("int").alias("at"))
    cut = F.concat(F.substring("run", F.lit(1), F.col("at")), F.substring(F.col("run"), F.col("at") + 2, F.length("run")))
    words = words.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= repeats)


def _signature(words: DataFrame, q: int) -> DataFrame:
    """(word, n, len, at, gram) with the q + 1 rarest positional grams of each word. One edit
    changes at most q of them, and what is left keeps its order on both sides, so the rarest
    gram that two words one edit apart share is in the signature of either."""
    size = F.length("word") - (q - 1)
    grams = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(F.col("word"), i, F.lit(q)))
    rows = words.select("word", "n", F.posexplode(grams).alias("at", "gram"))
    counts = written(rows.groupBy("gram").agg(F.count("*").alias("c")), "grams")
    small = F.broadcast(counts) if counts.count() <= MOST_GRAMS else counts
    best = F.slice(F.array_sort(F.collect_list(F.struct("c", "gram", "at"))), 1, q + 1)
    out = rows.join(small, "gram").groupBy("word", "n").agg(best.alias("best"))
    out = out.select("word", "n", F.length("word").alias("len"), F.explode("best").alias("b"))
    return written(out.select("word", "n", "len", "b.at", "b.gram"), "signatures")


def _split(rows: DataFrame, most: int) -> DataFrame:
    """(block, parts): the blocks of more than ``most`` rows; at most SHARE of them, as ``most``
    is at least that share of all rows."""
    return written(rows.groupBy("block").agg(F.count("*").alias("c")).where(F.col("c") > most).select("block", F.ceil(F.col("c") / most).cast("int").alias("parts")), "hot")


def _blocks(sig: DataFrame) -> DataFrame:
    """(block, word, n, indexed, asks): every word for each gram of its signature. A gram that
    many words have is split by length and place, where a word also asks the blocks of words one
    letter longer with the gram at its place or at the next; what is still large is split by a
    hash of the words indexed, and each part is asked. A word may be in a block twice, if grams
    repeat."""
    most = max(BLOCK, sig.count() // SHARE)
    keyed = sig.withColumn("block", F.xxhash64("gram"))
    hot = _split(keyed, most)
    yes, no = F.lit(True), F.lit(False)
    if hot.isEmpty():
        return keyed.select("block", "word", "n", yes.alias("indexed"), yes.alias("asks"))
    whole = keyed.join(F.broadcast(hot.select("block")), "block", "left_anti").select("block", "word", "n", yes.alias("indexed"), yes.alias("asks"))
    place = lambda d, a: F.xxhash64("gram", F.col("len") + d, F.col("at") + a)
    near = F.array(place(0, 0), place(1, 0), place(1, 1))
    fine = written(keyed.join(F.broadcast(hot.select("block")), "block").select("word", "n", near.alias("near")), "fine")
    own = fine.select(F.col("near")[0].alias("block"), "word", "n")
    parts = F.broadcast(_split(own, most))
    asks = fine.select(F.explode("near").alias("block"), "word", "n").join(parts, "block", "left")
    part = F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1))).cast("int")
    own = own.join(parts, "block", "left").select("block", part.alias("part"), "word", "n", yes.alias("indexed"), no.alias("asks"))
    asks = asks.select("block", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), "word", "n", no.alias("indexed"), yes.alias("asks"))
    fine = own.unionByName(asks).groupBy("block", "part", "word").agg(F.max("n").alias("n"), F.max("indexed").alias("indexed"), F.max("asks").alias("asks"))
    return whole.unionByName(fine.select(F.xxhash64("block", "part").alias("block"), "word", "n", "indexed", "asks"))


#: Rows of whole blocks that a task looks at together, and pairs of a word and a posting at once.
CHUNK_ROWS, PAIRS = 1 << 15, 1 << 20


def _codes(chars: np.ndarray, block: np.ndarray, q: int, shift: int) -> np.ndarray:
    """A 64-bit code of (block, place + shift, gram) for each place of words of one length.
    Codes that collide only make a pair more to verify."""
    size = chars.shape[1]
    out = np.zeros((len(chars), size - q + 1), U)
    for k in range(q):
        out = mix(out + chars[:, k : size - q + 1 + k].astype(U))
    place = np.arange(shift, shift + size - q + 1).astype(U)
    return mix(out + mix(mix(block.astype(U))[:, None] + place[None, :]))


def _merged(lists: tuple[np.ndarray, np.ndarray], rows: np.ndarray, many: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, posting) pairs that come up in any of the ``many`` shortest lists of each word:
    ``lists`` has the start and the length of its lists in ``rows``, the postings by code. One sort of
    a slice of words merges their lists."""
    start, size = lists
    keep = np.argpartition(size, many - 1, axis=1)[:, :many] if many < size.shape[1] else np.broadcast_to(np.arange(size.shape[1]), size.shape)
    start, size = np.take_along_axis(start, keep, 1), np.take_along_axis(size, keep, 1)
    total = np.cumsum(size.sum(axis=1))
    a = 0
    while a < len(total):
        done = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, done + PAIRS, "right")))
        s, n = start[a:b].ravel(), size[a:b].ravel()
        if n.sum():
            at = np.repeat(s - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            i = np.repeat(np.repeat(np.arange(a, b), size.shape[1]), n)
            both = np.sort(i * len(rows) + rows[at])
            both = both[np.r_[True, both[1:] != both[:-1]]]
            yield both // len(rows), both % len(rows)
        a = b


def _chunk_pairs(words: list[str], block: np.ndarray, indexed: np.ndarray, asks: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) in ``words`` of those one edit apart within their block."""
    sizes = np.array([len(w) for w in words])
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    of = {int(size): np.flatnonzero(sizes == size) for size in np.unique(sizes)}
    chars = {size: np.array([words[k] for k in at], dtype=f"U{size}").view(np.uint32).reshape(len(at), size) for size, at in of.items()}
    for size, at in of.items():
        need = size - 2 * q + 1  # grams that one edit leaves of words of this length
        ask = np.flatnonzero(asks[at])
        mine = chars[size][ask]
        for longer in (False, True):
            there = of.get(size + longer, np.zeros(0, np.int64))
            post = np.flatnonzero(indexed[there])
            if not len(ask) or not len(post):
                continue
            text = chars[size + longer][post]
            code = _codes(text, block[there[post]], q, 0)
            rows = np.repeat(np.arange(len(post)), code.shape[1])
            order = np.argsort(code, axis=None, kind="stable")
            code, rows = code.ravel()[order], rows[order]
            look = _codes(mine, block[at[ask]], q, 0)
            if longer:
                look = np.hstack([look, _codes(mine, block[at[ask]], q, 1)])
            first = np.searchsorted(code, look)
            lists = first, np.searchsorted(code, look, "right") - first
            # need - 1 of the lists are too few alone, so the longest are left out
            for i, j in _merged(lists, rows, look.shape[1] - (need + longer) + 1):
                a, b = mine[i], text[j]
                if longer:
                    head, tail = a == b[:, :size], (a == b[:, 1:])[:, ::-1]
                    whole = lambda e: np.where(e.all(axis=1), size, e.argmin(axis=1))
                    good = whole(head) + whole(tail) >= size
                else:
                    good = (a != b).sum(axis=1) == 1
                    k = (a != b).argmax(axis=1)
                    at_k = np.arange(len(a))
                    good &= a[at_k, k] < b[at_k, k]  # the other way round it is found from the other word
                found_a.append(at[ask[i[good]]])
                found_b.append(there[post[j[good]]])
    return np.concatenate(found_a), np.concatenate(found_b)


def _matches(q: int):
    """For mapInArrow over (block, word, n, indexed, asks) sorted by block: whole blocks, some
    at a time; of those of one row nothing is looked at."""
    names = ["a", "b", "na", "nb"]

    def pairs(t: pa.Table) -> list[pa.RecordBatch]:
        block = t.column("block").to_numpy()
        edge = np.r_[True, block[1:] != block[:-1]]
        several = ~(edge & np.r_[edge[1:], True])
        t, number = t.filter(pa.array(several)), np.cumsum(edge)[several]
        a, b = _chunk_pairs(t.column("word").to_pylist(), number, t.column("indexed").to_numpy(), t.column("asks").to_numpy(), q)
        w, n = t.column("word").combine_chunks(), t.column("n").combine_chunks()
        cols = [w.take(pa.array(a)), w.take(pa.array(b)), n.take(pa.array(a)), n.take(pa.array(b))]
        return pa.table(cols, names=names).combine_chunks().to_batches(max_chunksize=1 << 20)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            kept.append(batch)
            if sum(b.num_rows for b in kept) >= CHUNK_ROWS:
                t = pa.Table.from_batches(kept)
                block = t.column("block").to_numpy()
                cut = int(np.flatnonzero(block != block[-1])[-1]) + 1 if block[0] != block[-1] else 0
                if cut:
                    yield from pairs(t.slice(0, cut))
                    kept = t.slice(cut).to_batches()
        if kept and sum(b.num_rows for b in kept):
            yield from pairs(pa.Table.from_batches(kept))

    return run


def near_words(words: DataFrame, q: int = Q) -> DataFrame:
    """(a, b, na, nb): pairs of distinct words of ``words`` (word, n) that differ by exactly one
    inserted, deleted or replaced code point, each pair once, the shorter (or smaller) as a.

    Words have 2q letters at least (6); shorter ones would not be found and are refused. Rows
    that repeat a word are an error of the caller. An empty table gives an empty result."""
    if words.where(F.length("word") < 2 * q).limit(1).count():
        raise ValueError(f"words have at least {2 * q} letters")
    sig = _signature(words, q)
    dealt = _blocks(sig).repartition(shuffle_partitions(words.sparkSession), "block").sortWithinPartitions("block")
    return dealt.select("block", "word", "n", "indexed", "asks").mapInArrow(_matches(q), "a string, b string, na long, nb long").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of each chain, by doubling. A form is at least
    ``ratio`` times as frequent as its word, so chains are short and have no cycles."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("above"))
        nxt = written(at.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        drop(at.sparkSession, at)
        at = nxt
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")
        at.clonemesh_path = nxt.clonemesh_path


def variant_groups(words: DataFrame, ratio: int = 10, q: int = Q) -> DataFrame:
    """Spelling variants among ``words`` (word, n): for each its form, the near word
    (:func:`near_words`) of largest n, ties to the smallest in code-point order, if that n is at
    least ``ratio`` times its own.

    Returns one row for each word: word, form (null if none), root (the end of the chain of
    forms; the word itself if it has none), n, n_near (near words), form_n (the form's n).
    Words are distinct and have six letters or more. An empty table gives an empty result.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    words = written(words.select("word", "n"), "words")
    pairs = written(near_words(words, q), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("best.m")).alias("form_n"), F.col("best.other").alias("form"))
    good: Column = F.col("form_n") >= ratio * F.col("n")
    rows = written(rows.withColumns({"form": F.when(good, F.col("form")), "form_n": F.when(good, F.col("form_n"))}), "forms")
    roots = _roots(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least: int = 7, repeats: int = 2, every: int = 31, ratio: int = 10) -> DataFrame:
    """:func:`variant_groups` of :func:`word_counts` of whole texts. Null and empty texts have
    no words; copies count as often as they are there; an empty table gives an empty result."""
    return variant_groups(word_counts(docs, least, repeats, every), ratio)
