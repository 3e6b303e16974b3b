"""MinHash near-dedup with tensored banding.

Two small collections of ``tuples`` MinHash tuples are computed for each set; a table key
is a pair of one tuple from each, so tuples * tuples keys of 2 * rows values cost only
2 * tuples * rows MinHash values. Documents that share a key are compared on their full
sets; each document is compared with the key's hub first, and only what this leaves in several
parts is compared further, in blocks of documents of about one size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import looked_up
from .common import arrow_batches, release, text_or_empty, written
from .components import components
from .scan import U, Words, mix, rolling, words

_SEEDS = mix(np.arange(1, 4097, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def shingle_sets(w: Words, k: int) -> Iterator[np.ndarray]:
    """Of each text of a block, the sorted distinct hashes of its k-word shingles; of fewer
    words, the whole sequence; of none, nothing."""
    r = rolling(w.h, k)
    for i, c in enumerate(w.counts().tolist()):
        f = int(w.first[i])
        yield np.unique(r[f : f + c - k + 1]) if c >= k else rolling(w.h[f : f + c], c) if c else np.zeros(0, U)


def _minima(s: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, ~U(0))
    for i in range(0, len(s), 4096):
        np.minimum(out, (s[i : i + 4096, None] * _SEEDS[None, :n]).min(axis=0), out=out)
    return out


def _sketches(tuples: int, rows: int, k: int):
    n = 2 * tuples * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, s1, s2, mins = [], [], [], []
            for w in words(b.column(1), lower=True):
                for s in shingle_sets(w, k):
                    size.append(len(s))
                    s1.append(np.add.reduce(mix(s)) if len(s) else U(0))
                    s2.append(np.add.reduce(mix(s ^ _SEEDS[-1])) if len(s) else U(0))
                    mins.append(_minima(s, n) if len(s) else None)
            m = np.stack([np.zeros(n, U) if x is None else x for x in mins]) if mins else np.zeros((0, n), U)
            t = mix((m.reshape(-1, 2 * tuples, rows) * _SEEDS[None, None, -rows - 1 : -1]).sum(axis=2, dtype=U)).view(np.int64)
            none = pa.array([x is None for x in mins], pa.bool_())

            def arrays(x: np.ndarray) -> pa.Array:
                off = pa.array(np.arange(len(x) + 1, dtype=np.int32) * tuples)
                return pa.ListArray.from_arrays(off, pa.array(np.ascontiguousarray(x).reshape(-1)), mask=none if len(x) else None)

            cols = [b.column(0), b.column(2), pa.array(size, pa.int64()), pa.array(np.array(s1, U).view(np.int64)), pa.array(np.array(s2, U).view(np.int64)), arrays(t[:, :tuples]), arrays(t[:, tuples:])]
            yield pa.record_batch(cols, names=["doc_id", "th", "n", "s1", "s2", "ta", "tb"])

    return run


#: Documents and shingles of one block.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1 << 18


def _blocks(rows: DataFrame, key: str) -> DataFrame:
    """The written table ``rows`` (with n) and the number of blocks for all that share a key."""
    n = F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    return looked_up(rows, key, rows.groupBy(F.col(key).alias("node")).agg(n.alias("root")), "blocks")


def _texts(rows: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` (cls, ...) with the text of each class's first document."""
    ids = classes.join(rows.select("cls").distinct(), "cls", "left_semi").select("cls", F.col("doc_id"), "th")
    one = docs.join(ids.hint("merge"), ["doc_id", "th"]).groupBy("cls").agg(F.min("_cm_text").alias("_cm_text"))
    return rows.join(one.hint("merge"), "cls")


def _sets(t: pa.Table, k: int) -> list[np.ndarray]:
    return [s for w in words(t.column("_cm_text"), lower=True) for s in shingle_sets(w, k)]


def _confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, threshold: int, k: int) -> DataFrame:
    """Those (hub, cls) whose full sets have 100 * intersection >= threshold * union, as (a, b).

    A hub's members are dealt into blocks by a hash and its own text goes to each block once,
    so no task holds a hub's pairs and no pair carries two texts."""

    def run(t: pa.Table) -> pa.Table:
        hub, ids = t.column("hub")[0].as_py(), t.column("cls").to_numpy()
        sets, found = _sets(t, k), []
        a = sets[int(np.flatnonzero(ids == hub)[0])]
        for i in np.flatnonzero(ids != hub).tolist():
            b = sets[i]
            both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum()) if len(a) else 0
            if both and 100 * both >= threshold * (len(a) + len(b) - both):
                found.append(int(ids[i]))
        return pa.table([pa.array([min(hub, x) for x in found], pa.int64()), pa.array([max(hub, x) for x in found], pa.int64())], names=["a", "b"])

    pairs = _blocks(pairs, "hub").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    hubs = pairs.select("hub", "block").distinct().withColumn("cls", F.col("hub"))
    both = _texts(pairs.select("hub", "block", "cls").unionByName(hubs), classes, docs)
    return written(both.groupBy("hub", "block").applyInArrow(run, "a long, b long").distinct(), "links")


def _blocked(parts: DataFrame, classes: DataFrame, docs: DataFrame, threshold: int, k: int) -> DataFrame:
    """Links between documents of one candidate cluster that are not in one part yet.

    Documents that share keys form clusters. Sizes of linked sets differ by less than
    a factor of 100 / threshold, so a cluster's documents are put into classes by the logarithm of
    their size to that base, and only equal or neighbouring classes are compared: each is
    dealt into blocks, and each pair of blocks is one small group whose intersections are
    products of incidence matrices. No pair becomes a row: a group gives each document with
    links the smallest document that these reach within the group."""
    cluster = components(parts.select(F.col("cls").alias("a"), F.col("low").alias("b")))
    own = parts.groupBy("cls", "n").agg(F.min("part").alias("part"))
    own = looked_up(written(own, "parts"), "cls", cluster, "root").withColumn("root", F.coalesce("root", "cls"))
    own = own.withColumn("size", F.floor(F.log(F.col("n")) / (max(np.log(100 / threshold), 0.01) + 1e-9)).cast("int"))
    gk = lambda d: F.xxhash64("root", F.col("size") + d)
    own = written(own.withColumns({"gk": gk(0), "up": gk(1), "down": gk(-1)}), "parts")
    blocks = own.groupBy(F.col("gk").alias("node")).agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("root"))
    blocks = written(blocks, "blocks")
    for key, name in (("gk", "blocks"), ("up", "above"), ("down", "below")):
        own = written(looked_up(own, key, blocks, name), "parts")
    own = own.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    upto = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda c1, i, c2, j: F.struct(c1.alias("c1"), i.alias("i"), c2.alias("c2"), j.alias("j"))
    c, b = F.col("size"), F.col("block")
    groups = F.concat(
        F.transform(upto("blocks"), lambda o: pair(c, F.least(b, o), c, F.greatest(b, o))),
        F.transform(upto("above"), lambda o: pair(c, b, c + 1, o)),
        F.transform(upto("below"), lambda o: pair(c - 1, o, c, b)),
    )
    own = own.withColumn("side", c.cast("long") * F.lit(1 << 32) + b)
    own = own.select("root", F.explode(groups).alias("g"), "side", "part", "cls").select("root", "g.*", "side", "part", "cls")

    def run(t: pa.Table) -> pa.Table:
        ids_, part, side = (t.column(x).to_numpy() for x in ("cls", "part", "side"))
        sets = _sets(t, k)
        size = np.array([len(s) for s in sets], np.float64)
        h, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        o = np.argsort(h, kind="stable")
        h, doc = h[o], doc[o]
        st = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        count = np.diff(np.r_[st, len(h)])
        term = np.repeat(np.cumsum(count > 1) - 1, count)
        several = np.repeat(count > 1, count)
        term, doc = term[several], doc[several]
        both = np.zeros((len(sets), len(sets)), np.float64)
        step = 4096
        cut = np.searchsorted(term, np.arange(0, (int(term[-1]) if len(term) else -1) + step + 1, step))
        for c, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
            m = np.zeros((len(sets), step), np.float32)
            m[doc[a:b], term[a:b] - c * step] = 1
            both += m @ m.T
        linked = (100 * both >= threshold * (size[:, None] + size[None, :] - both)) & (both > 0) & (part[:, None] != part[None, :])
        if (side != side[0]).any():
            linked &= side[:, None] != side[None, :]
        label = ids_.copy()
        while True:
            now = np.minimum(label, np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (now == label).all():
                break
            label = now
        hit = label < ids_
        return pa.table([ids_[hit], label[hit]], names=["a", "b"])

    return written(_texts(own, classes, docs).groupBy("root", "c1", "i", "c2", "j").applyInArrow(run, "a long, b long"), "links")


def near_duplicates(docs: DataFrame, threshold: int = 80, k: int = 5, tuples: int = 8, rows: int = 3, with_hash: bool = False) -> DataFrame:
    """Classes of near-duplicate documents.

    A-Z are lowered; a document's set has its distinct ``k``-word shingles, or its whole
    word sequence if it has fewer words. Documents are linked if 100 * |A and B| >=
    ``threshold`` * |A or B|; every link is confirmed on the full sets. Returns one row for
    each row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id reachable
    over links), kept (doc_id = component_id).

    Equal sets form one class first, so copies are never expanded into pairs. A pair at
    similarity s has a key in common with probability (1 - (1 - s^rows)^tuples)^2: 0.9990 at 0.85
    and 0.9936 at 0.8 by default. Texts that are null, empty or without words are linked
    with nothing. Rows with a null doc_id are linked with nothing and kept. Rows that
    repeat a doc_id are judged each by its own text. An empty table gives an empty result. A text is held whole in a worker. With ``with_hash`` there is also
    text_hash (xxhash64 of the text), which tells the rows of one id apart.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("_cm_text"))
    docs = docs.withColumn("th", F.xxhash64("_cm_text"))
    sk = docs.mapInArrow(_sketches(tuples, rows, k), "doc_id long, th long, n long, s1 long, s2 long, ta array<long>, tb array<long>")
    sk = written(sk, "sketches")
    with_set = sk.where("n > 0 and doc_id is not null")
    low = F.min(F.struct("doc_id", "th"))
    classes = with_set.groupBy("n", "s1", "s2").agg(low.alias("low"), F.count("*").alias("copies"), F.min("ta").alias("ta"), F.min("tb").alias("tb"))
    # cls numbers the classes; doc_id and th are those of the class's first document
    classes = classes.select("n", "s1", "s2", F.col("low.doc_id").alias("doc_id"), F.col("low.th").alias("th"), "copies", "ta", "tb")
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    release(spark)
    keys = classes.select("cls", "n", "copies", F.explode(F.expr(f"flatten(transform(ta, (x, i) -> transform(tb, (y, j) -> xxhash64(x, y, i * {tuples} + j))))")).alias("key"))
    member = F.struct("cls", "n")
    groups = keys.groupBy("key").agg(F.count("*").alias("size"), F.max(F.struct("copies", (-F.col("cls")).alias("neg"), "n")).alias("hub"), F.min(member).alias("low"), F.max(member).alias("high")).where("size > 1")
    groups = written(groups.select("key", "size", (-F.col("hub.neg")).alias("hub"), F.col("hub.n").alias("hn"), "low", "high"), "groups")
    members = written(keys.join(groups.where("size > 2").select("key", "hub", "hn"), "key").select("key", "cls", "n", "hub", "hn"), "members")
    release(spark)
    two = groups.where("size = 2 and low.cls < high.cls").select(F.col("low.cls").alias("hub"), F.col("low.n").alias("hn"), F.col("high.cls").alias("cls"), F.col("high.n").alias("n"))
    pairs = two.unionByName(members.drop("key")).where(f"cls <> hub and 100 * least(n, hn) >= {threshold} * greatest(n, hn)")
    links = _confirm(written(pairs.distinct(), "pairs"), classes, docs, threshold, k)
    roots = components(links)

    # keys whose members are still in several parts: their candidate clusters, in blocks
    parts = looked_up(members.drop("hub", "hn"), "cls", roots, "part").withColumn("part", F.coalesce("part", "cls"))
    mixed = parts.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.min("cls").alias("low")).where("lo < hi").select("key", "low")
    parts = written(parts.join(mixed, "key").select("cls", "n", "part", "low"), "parts")
    if not parts.isEmpty():
        roots = components(links.union(_blocked(parts, classes, docs, threshold, k)))
    # a component's name is its smallest doc_id
    own = written(roots.join(classes.select(F.col("cls").alias("node"), "doc_id"), "node"), "roots")
    own = looked_up(own, "root", own.groupBy(F.col("root").alias("node")).agg(F.min("doc_id").alias("root")), "component")
    reps = classes.select("n", "s1", "s2", F.col("cls").alias("node"), "doc_id").join(own.select("node", "component"), "node", "left")
    reps = reps.select("n", "s1", "s2", F.coalesce("component", "doc_id").alias("component"))
    out = sk.select("doc_id", "th", "n", "s1", "s2").join(reps, ["n", "s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), *([F.col("th").alias("text_hash")] if with_hash else []))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
