"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators.

Indicators are byte 1- to 3-grams, 1- and 2-grams of words, and 1- to 3-grams of word shapes
(case, last mark, length class, equal to one of the two words before), so that invented or
rare words do not matter. Class counts come from a bounded sample of the labelled training
rows; the linear model, over indicators scaled by the classes' log-count ratios, is fitted by
dual coordinate descent on a part of it, in one task: a row of the sample is at most a bit for
each indicator, so the task holds SAMPLE * 2 rows of at most 32 kB, and the driver only the
counts and the weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, written
from .scan import U, Words, mix, rolling, words

#: Indicators: one half for bytes and shapes, the other one for words.
BITS = 17
DIM = 2 << BITS
_SLICES = 64
#: Bytes of texts whose n-grams are hashed at once.
BLOCK = 1 << 18
#: Sampled training rows of each class: for the linear model, and for class counts. The ids
#: of the latter, some 16 bytes each, are all that is broadcast.
SAMPLE, COUNTED = 4000, 16_384


def _shapes(w: Words) -> np.ndarray:
    """A small code for the shape of each word, mixed to 64 bits."""
    d = w.data
    upper, lower, digit = (d >= 65) & (d <= 90), (d >= 97) & (d <= 122), (d >= 48) & (d <= 57)
    sums = [np.r_[0, np.cumsum(x)] for x in (upper, lower, digit, d >= 128)]
    s, e = w.starts, w.ends
    nu, nl, nd, nh = (x[e] - x[s] for x in sums)
    n = e - s
    letters = nu + nl + nh
    last = d[e - 1].astype(np.int64) if len(e) else np.zeros(0, np.int64)
    last = np.where((last >= 128) | ((last >= 97) & (last <= 122)), 97, np.where((last >= 65) & (last <= 90), 65, np.where((last >= 48) & (last <= 57), 48, last)))
    case = np.where(letters == 0, 3, np.where((nl == 0) & (nu > 0), 2, np.where(upper[s] if len(s) else False, 1, 0)))
    size = np.minimum(np.ceil(np.log2(n + 1)), 7).astype(np.int64)
    same = np.zeros(len(s), np.int64)
    pos = np.arange(len(s)) - np.repeat(w.first[:-1], np.diff(w.first))
    for k in (2, 1):
        if len(s) > k:
            eq = (w.h[k:] == w.h[:-k]) & (pos[k:] >= k)
            same[k:][eq] = k
    mixed = (nd > 0) * 2 + (letters + nd < n - 1)
    code = ((((last * 4 + case) * 8 + size) * 3 + same) * 4 + mixed).astype(U)
    return mix(code + U(0x5EED))


def features(w: Words) -> Iterator[np.ndarray]:
    """Of each text of a block, the sorted indices of its indicators."""
    d = w.data.astype(np.int64)
    grams = []
    for n in (1, 2, 3):
        m = len(d) - n + 1
        if m <= 0:
            break
        x = d[:m].copy()
        for k in range(1, n):
            x = x * 256 + d[k : m + k]
        grams.append(((x + (n << 40)).astype(U) * U(0x9E3779B97F4A7C15) >> U(64 - BITS)).astype(np.int64))
    shape = _shapes(w)
    shapes = [(rolling(shape, n) >> U(64 - BITS)).astype(np.int64) for n in (1, 2, 3)]
    terms = [(rolling(w.h, n) >> U(64 - BITS)).astype(np.int64) + (1 << BITS) for n in (1, 2)]
    seen = np.zeros(DIM, bool)
    edge = w.text_offsets
    for i in range(w.r1 - w.r0):
        a, b = int(edge[i]), int(edge[i + 1])
        f, g = int(w.first[i]), int(w.first[i + 1])
        for n, x in enumerate(grams, 1):
            seen[x[a : max(a, b - n + 1)]] = True
        for own in (shapes, terms):
            for n, x in enumerate(own, 1):
                seen[x[f : max(f, g - n + 1)]] = True
        idx = np.flatnonzero(seen)
        seen[idx] = False
        yield idx


def _packed(idx: np.ndarray) -> bytes:
    """Indices as numbers, or, where that is shorter, as a bit for each indicator."""
    if 4 * len(idx) < DIM // 8:
        return idx.astype(np.int32).tobytes()
    bits = np.zeros(DIM, bool)
    bits[idx] = True
    return np.packbits(bits).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8))) if len(raw) == DIM // 8 else np.frombuffer(raw, np.int32)


class _Rows:
    """Sampled rows: the indices of row i, or with ``ratio`` their values of unit length."""

    def __init__(self, raw: list[bytes], ratio: np.ndarray | None = None, scale: np.ndarray | None = None):
        self.raw, self.ratio, self.scale = raw, ratio, scale
        if ratio is not None and scale is None:
            square = ratio.astype(np.float64) ** 2
            self.scale = np.array([1 / (np.sqrt(square[_unpacked(x)].sum()) or 1.0) for x in raw], np.float32)

    def __len__(self) -> int:
        return len(self.raw)

    def __getitem__(self, i: int) -> np.ndarray:
        x = _unpacked(self.raw[i])
        return x if self.ratio is None else self.ratio[x] * self.scale[i]

    def some(self, at: np.ndarray) -> "_Rows":
        return _Rows([self.raw[i] for i in at.tolist()], self.ratio, None if self.scale is None else self.scale[at])


def _train_rows(rate: dict[int, float]):
    """Counts of each indicator by class, in slices; and the indicators of sampled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = np.zeros((2, DIM), np.int64), False
        names = ["slice", "y", "idx", "low", "high"]
        for b in batches:
            ys, picks = b.column(1).to_pylist(), b.column(2).to_pylist()
            out_y, out_x, i = [], [], 0
            for w in words(b.column(0), target=BLOCK):
                for idx in features(w):
                    count[ys[i], idx] += 1
                    if picks[i] < rate[ys[i]]:
                        out_y.append(ys[i])
                        out_x.append(_packed(idx))
                    i += 1
                    seen = True
            none = pa.nulls(len(out_y), pa.list_(pa.int64()))
            yield pa.record_batch([pa.array([-1] * len(out_y), pa.int32()), pa.array(out_y, pa.int32()), pa.array(out_x, pa.binary()), none, none], names=names)
        if seen:
            part = count.reshape(2, _SLICES, -1)
            yield pa.record_batch([pa.array(range(_SLICES), pa.int32()), pa.nulls(_SLICES, pa.int32()), pa.nulls(_SLICES, pa.binary()), pa.array(list(part[0]), pa.list_(pa.int64())), pa.array(list(part[1]), pa.list_(pa.int64()))], names=names)

    return run


def _sum_slices(t: pa.Table) -> pa.Table:
    low, high = (np.stack([np.asarray(x) for x in t.column(c).to_pylist()]).sum(axis=0) for c in ("low", "high"))
    return pa.table([pa.array([t.column("slice")[0].as_py()], pa.int32()), pa.array([low], pa.list_(pa.int64())), pa.array([high], pa.list_(pa.int64()))], names=["slice", "low", "high"])


def descend(xs: Sequence[np.ndarray], vals: Sequence[np.ndarray], y: np.ndarray, dim: int, c: float = 1.0, epochs: int = 15, seed: int = 7) -> np.ndarray:
    """Hinge-loss linear model by dual coordinate descent; the last weight is the bias."""
    rng = np.random.default_rng(seed)
    w, alpha = np.zeros(dim + 1), np.zeros(len(y))
    q = np.array([1.0 + float(vals[i] @ vals[i]) for i in range(len(y))])
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(y)):
            x, v = xs[i], vals[i]
            g = y[i] * (w[x] @ v + w[-1]) - 1
            new = min(max(alpha[i] - g / q[i], 0.0), c)
            if step := (new - alpha[i]) * y[i]:
                w[x] += step * v
                w[-1] += step
                most = max(most, abs(step))
                alpha[i] = new
        if most < 1e-3:
            break
    return w


def _platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a * margin + b))) by Newton steps on the weighted likelihood."""
    a, b = 1.0, 0.0
    t = np.where(y > 0, 1 - 1e-3, 1e-3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        g = weight * (p - t)
        h = weight * p * (1 - p) + 1e-9
        m = np.array([[(h * margin**2).sum() + 1e-6, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        da, db = np.linalg.solve(m, [(g * margin).sum() + 1e-6 * a, g.sum()])
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-8:
            break
    return float(a), float(b)


class Model:
    """weights over indicators (already times the ratios), bias, and the ratios' squares."""

    def __init__(self, weight: np.ndarray, bias: float, square: np.ndarray, a: float, b: float):
        self.weight, self.bias, self.square, self.a, self.b = weight, bias, square, a, b

    def score(self, idx: np.ndarray) -> float:
        norm = np.sqrt(self.square[idx].sum()) or 1.0
        z = self.a * (self.weight[idx].sum() / norm + self.bias) + self.b
        return float(1 / (1 + np.exp(-min(max(z, -35.0), 35.0))))


def _fitted(raw: list[bytes], y01: np.ndarray, ratio: np.ndarray, n: dict[int, int]) -> tuple[np.ndarray, float, float, float]:
    """Weights, bias and the two numbers of the calibration, from the sampled rows. Rows are
    weighted by their class's share of all labelled rows in the calibration only."""
    # a fixed order, whatever order the rows came in
    order = sorted(range(len(raw)), key=lambda i: (y01[i], len(raw[i]), zlib.crc32(raw[i])))
    raw, ys = [raw[i] for i in order], np.where(y01[order] > 0, 1.0, -1.0)
    xs, vals = _Rows(raw), _Rows(raw, ratio)
    have = {v: max((ys == v).sum(), 1) for v in (-1, 1)}
    weight = np.where(ys > 0, n[1] / have[1], n[0] / have[-1])
    margin = np.zeros(len(ys))
    fold = np.arange(len(ys)) % 2
    for k in (0, 1):
        tr = np.flatnonzero(fold != k)
        w = descend(xs.some(tr), vals.some(tr), ys[tr], DIM)
        for i in np.flatnonzero(fold == k).tolist():
            margin[i] = w[xs[i]] @ vals[i] + w[-1]
    a, b = _platt(margin, ys, weight)
    w = descend(xs, vals, ys, DIM)
    return w[:-1] * ratio, float(w[-1]), a, b


def log_ratio(count: np.ndarray) -> np.ndarray:
    """The log-count ratio of each indicator from ``count`` (class, indicator), smoothed by 1;
    0 where fewer than 3 rows have the indicator."""
    p, q = count[1] + 1, count[0] + 1
    ratio = np.log((p / p.sum()) / (q / q.sum())).astype(np.float32)
    ratio[(count[0] + count[1]) < 3] = 0.0
    return ratio


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, counted: int = COUNTED) -> Model:
    """Fit on labelled rows that are not held out (crc32 of doc_id as text modulo 5 is 0).
    About ``counted`` rows of each class, chosen by a hash of doc_id, give the class counts,
    and ``sample`` of them fit the linear model and its calibration."""
    y = F.col(label).cast("int")
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), y.alias("y")).where("y in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    ids = ids.where(~_held_out("doc_id"))
    n = {r["y"]: r["count"] for r in ids.groupBy("y").count().collect()}
    if len(n) < 2:
        p = min(max(n.get(1, 0) / max(sum(n.values()), 1), 0.001), 0.999) if n else 0.5
        return Model(np.zeros(DIM), 0.0, np.ones(DIM), 0.0, float(np.log(p / (1 - p))))
    pick = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    picked = ids.withColumn("pick", pick).where(" or ".join(f"(y = {k} and pick < {counted / v})" for k, v in n.items()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").select("text", "y", "pick")
    both = rows.mapInArrow(_train_rows({k: sample / v for k, v in n.items()}), "slice int, y int, idx binary, low array<bigint>, high array<bigint>")
    both = written(both, "training")
    counts = both.where("slice >= 0").select("slice", "low", "high").groupBy("slice").applyInArrow(_sum_slices, "slice int, low array<bigint>, high array<bigint>").toArrow()
    count = np.zeros((2, DIM))
    for i, k in enumerate(counts.column("slice").to_pylist()):
        at = slice(k * DIM // _SLICES, (k + 1) * DIM // _SLICES)
        count[0, at], count[1, at] = (np.asarray(counts.column(c)[i].values) for c in ("low", "high"))
    ratio = log_ratio(count)

    def task(t: pa.Table) -> pa.Table:
        w, bias, a, b = _fitted(t.column("idx").to_pylist(), t.column("y").to_numpy(), ratio, n)
        return pa.table([[w.astype(np.float64).tobytes()], [bias], [a], [b]], schema=pa.schema([("w", pa.binary()), *((c, pa.float64()) for c in ("bias", "a", "b"))]))

    got = both.where("slice < 0").select(F.lit(0).alias("g"), "y", "idx").groupBy("g").applyInArrow(task, "w binary, bias double, a double, b double").collect()
    square = ratio.astype(np.float64) ** 2
    if not got:  # no labelled row has a document
        return Model(np.zeros(DIM), 0.0, square, 0.0, float(np.log(n[1] / n[0])))
    r = got[0]
    return Model(np.frombuffer(r["w"], np.float64), r["bias"], square, r["a"], r["b"])


def _held_out(col: str):
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % 5 == 0


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """All columns of ``docs`` with ``column``: the score of each whole text, 0 to 1. A null
    text is an empty one, which gets the model's score of no indicators."""
    arrow_batches(docs.sparkSession)
    m = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [m.value.score(idx) for w in words(b.column(at).cast(pa.string()), target=BLOCK) for idx in features(w)]
            yield pa.record_batch([*b.columns, pa.array(s, pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= ``threshold``) of each row.

    The model is fitted on ``docs`` joined with ``labels`` as in :func:`fit`; score and label
    1 go together. Only texts are inputs of a score. Null ids count as the empty text for
    held_out and are never trained on; repeated label rows of an id count once, with the
    larger label; rows that repeat an id with different texts are each trained on. Without
    labels of both classes every score is the share of label 1, or 0.5. A text is held whole
    in a worker. An empty table gives an empty result.
    """
    model = fit(docs, labels, sample=sample)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = score(slim, model)
    return out.select("doc_id", _held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their columns; nulls,
    repeated ids and empty tables as in :func:`classify`."""
    model = fit(docs, labels)
    return score(docs, model, "_cm_score").where(F.col("_cm_score") >= threshold).drop("_cm_score")
