"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells.

Vectors are compared with those of their own length only; each length has its own cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, written
from .components import components

#: Vectors the cells are fitted on, cells at most, vectors and queries of one product, and
#: numbers of a matrix of scores that a task holds at once.
SAMPLE, MOST_CELLS, BLOCK, QUERIES, SCORES = 16_384, 16_384, 1024, 4096, 1 << 22
#: Lengths of vectors with cells of their own; the others, each with fewer vectors than
#: any of these, have one cell each, whose blocks are compared in full.
MOST_LENGTHS = 8


def _rows(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.chunk(0) if arr.num_chunks else pa.array([], pa.list_(pa.float64()))
    return np.asarray(arr.flatten(), np.float64).reshape(len(arr), -1) if len(arr) else np.zeros((0, 1))


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of one length as unit vectors in double precision."""
    return _unit(_rows(col))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """k unit centroids of unit vectors; an empty cell keeps its centroid."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        step = max(1, SCORES // k)
        a = np.concatenate([(x[i : i + step] @ c.T).argmax(axis=1) for i in range(0, len(x), step)])
        s = np.zeros_like(c)
        np.add.at(s, a, x)
        n = np.sqrt((s * s).sum(axis=1))
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


def _near(raw: np.ndarray, x: np.ndarray, q: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether cosines reach ``threshold``; those within rounding of it are computed again as
    the product over both lengths."""
    s = x[q] @ x[y].T
    near = s >= threshold
    for i, j in zip(*np.nonzero(np.abs(s - threshold) < 1e-12)):
        a, b = raw[q[i]], raw[y[j]]
        with np.errstate(over="ignore", under="ignore"):
            size = np.sqrt(a @ a) * np.sqrt(b @ b)
        if np.isfinite(size) and size > 1e-290:
            near[i, j] = (a @ b) / size >= threshold
    return near


def _compare(threshold: float):
    none = np.iinfo(np.int64).max

    def run(t: pa.Table) -> pa.Table:
        is_query = t.column("query").to_numpy(zero_copy_only=False)
        raw = _rows(t.column("embedding"))
        x = _unit(raw)
        ids, copies, home = (t.column(c).to_numpy() for c in ("rep", "copies", "home"))
        cell = t.column("cell")[0].as_py()
        q, y = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        if not len(q) or not len(y):
            return pa.table([pa.array([], pa.int64())] * 3, names=["rep", "links", "label"])
        links = np.zeros(len(ids), np.int64)
        label = ids.copy()
        near = [_near(raw, x, q[i : i + 1024], y, threshold) & (ids[q[i : i + 1024], None] != ids[y][None, :]) for i in range(0, len(q), 1024)]
        near = np.concatenate(near)
        links[q] = near @ copies[y]
        probes = t.column("probes").combine_chunks()
        foreign = np.flatnonzero(home[q] != cell)
        if near[foreign].any():  # what a neighbour that does not visit the other's cell misses
            p = np.asarray(pa.concat_arrays(probes.chunks).flatten() if isinstance(probes, pa.ChunkedArray) else probes.flatten()).reshape(len(ids), -1)
            for i in foreign:
                hit = y[near[i]]
                blind = hit[~(p[hit] == home[q[i]]).any(axis=1)]
                links[blind] += copies[q[i]]
        while True:
            ql = np.minimum(label[q], np.where(near, label[y][None, :], none).min(axis=1))
            yl = np.minimum(label[y], np.where(near, ql[:, None], none).min(axis=0))
            if (ql == label[q]).all() and (yl == label[y]).all():
                break
            label[q], label[y] = ql, yl
        keep = (links > 0) | (label < ids)
        return pa.table([ids[keep], links[keep], label[keep]], names=["rep", "links", "label"])

    return run


def _fit(classes: DataFrame, dim: int, n: int, sample: int) -> np.ndarray:
    """Centroids for the ``n`` vectors of a length, from about ``sample`` of them."""
    share = min(1.0, sample / n)
    mine = classes.where((F.size("embedding") == dim) & (F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1 << 30)) <= int(share * (1 << 30))))
    x = _matrix(mine.orderBy("rep").limit(2 * sample).select("embedding").toArrow().column(0))
    k = int(max(1, min(MOST_CELLS, np.sqrt(n), len(x))))
    return spherical_kmeans(x, k) if len(x) else np.zeros((1, dim))


def _assigned(b: pa.RecordBatch, centroids: np.ndarray, probes: int) -> pa.RecordBatch:
    """Vectors of one length with their nearest cell (home) and their nearest cells."""
    x, n = _matrix(b.column(0)), min(probes, len(centroids))
    top = np.zeros((len(x), n), np.int32)
    step = max(1, SCORES // len(centroids))
    for i in range(0, len(x), step):
        s = -(x[i : i + step] @ centroids.T)
        near = np.argpartition(s, n - 1, axis=1)[:, :n]
        own = np.take_along_axis(s, near, axis=1)
        top[i : i + step] = np.take_along_axis(near, np.lexsort((near, own), axis=1), axis=1)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * n), pa.array(top.reshape(-1)))
    dim = pa.array(np.full(len(x), centroids.shape[1], np.int32))
    return pa.record_batch([*b.columns, dim, pa.array(top[:, 0]), lists], names=["embedding", "rep", "copies", "dim", "home", "probes"])


#: Cells that a vector visits at least.
LEAST_PROBES = 4


def near_vectors(vectors: DataFrame, threshold: float = 0.9, probes: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (the smallest vec_id
    reachable over links) and kept (vec_id = component_id) for each row of ``vectors``.

    Equal vectors form one class first. For each length of vectors, spherical k-means, fitted
    on a sample of ``sample`` vectors chosen by a hash of their ids, gives about the square
    root of their number of cells. Every class is indexed in its nearest cell and looks for
    neighbours in its ``probes`` nearest cells, so a pair is found if either one visits the
    other's cell; the cosine of every link is computed in double precision and at least
    ``threshold``. By default probes are the root of the number of cells, four at least, as
    with more cells a pair is more often parted.

    A cell's vectors and visitors are dealt into blocks by a hash, so a cell with a third of
    all vectors is many small products. No pair becomes a row. Vectors that are null, empty
    or zero, or hold null or non-finite components, are linked with nothing; vectors of
    different lengths are not linked with each other. Rows that repeat a vec_id are one
    vector if they are equal, else each counts. Rows without a vec_id are linked with nothing,
    component null, and kept. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    arrow_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda v: v.cast("double")).alias("embedding"))
    # 128 bits stand for a vector wherever only equality matters
    rows = rows.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(7), "embedding")})
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    good = rows.where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))
    classes = written(good.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"), F.first("embedding").alias("embedding")), "vectors")
    sizes = classes.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(MOST_LENGTHS).collect()
    result = None
    if sizes:
        cells = spark.sparkContext.broadcast({r["dim"]: _fit(classes, r["dim"], r["count"], sample) for r in sizes})

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                dims = pc.list_value_length(b.column(0)).to_numpy()
                for dim in np.unique(dims).tolist():
                    part = b.filter(pa.array(dims == dim))
                    own = cells.value.get(dim, np.zeros((1, dim)))
                    yield _assigned(part, own, probes or max(LEAST_PROBES, int(np.ceil(np.sqrt(len(own))))))

        placed = written(classes.select("embedding", "rep", "copies").mapInArrow(assign, "embedding array<double>, rep long, copies long, dim int, home int, probes array<int>"), "cells")
        cell = ["dim", "cell"]
        seen = placed.select("dim", F.explode("probes").alias("cell")).groupBy(*cell).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("nq"))
        held = placed.groupBy("dim", F.col("home").alias("cell")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
        shape = written(seen.join(held, cell), "shape")
        # a row for each cell: at most MOST_LENGTHS * MOST_CELLS and one for each other length
        shape = F.broadcast(shape) if shape.count() <= 2 * MOST_LENGTHS * MOST_CELLS else shape
        base = ["rep", "copies", "home", "probes", "embedding"]
        index = placed.withColumn("cell", F.col("home")).join(shape, cell).select(*base, *cell, F.pmod(F.xxhash64("rep", F.lit(1)), F.col("nb")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("chunk"), F.lit(False).alias("query"))
        query = placed.withColumn("cell", F.explode("probes")).join(shape, cell).select(*base, *cell, F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("block"), F.pmod(F.xxhash64("rep", F.lit(2)), F.col("nq")).cast("int").alias("chunk"), F.lit(True).alias("query"))
        result = index.unionByName(query).groupBy(*cell, "block", "chunk").applyInArrow(_compare(threshold), "rep long, links long, label long")
        result = written(result, "links")
    linked = result if result is not None else spark.createDataFrame([], "rep long, links long, label long")
    total = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(linked.select(F.col("rep").alias("a"), F.col("label").alias("b"))).withColumnRenamed("node", "rep")
    done = classes.select("h1", "h2", "rep", "copies").join(total, "rep", "left").join(roots, "rep", "left")
    done = done.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    out = rows.withColumn("_cm_ok", F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))
    keyed = out.where("_cm_ok").select("vec_id", "h1", "h2").join(done, ["h1", "h2"], "left")
    alone = out.where("not _cm_ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = keyed.select("vec_id", "n_links", "component_id").unionByName(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
