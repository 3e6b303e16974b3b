from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from clonemesh.llm import quality


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " ".join((word().upper() + "!!" if bad else word()) for _ in range(60))))
        if i % 5:
            labels.append((i, 0 if bad else 1, 0))
    rows += [(1000, None), (1001, ""), (None, "abc def"), (5, rows[5][1])]
    labels += [(5, 1, 0), (7, None, None), (None, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    got = quality.classify(docs, labels).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in got)
    own = [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 4 != 0) for r in own]) > 0.95


def test_filter_keeps_columns(labelled, spark):
    docs, labels = labelled
    from pyspark.sql import functions as F

    wide = docs.withColumns({"y": F.lit(1), "pick": F.lit("a"), "score": F.lit(2.0)})
    kept = quality.keep_good(wide, labels)
    assert kept.columns == wide.columns
    assert 280 < kept.count() < 320
    assert quality.keep_good(wide.limit(0), labels).count() == 0


def test_without_labels(labelled, spark):
    docs, labels = labelled
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert all(r.predicted for r in quality.classify(docs, labels.where("quality = 1")).collect())


def test_descent_separates():
    x = [np.array([0]), np.array([1])] * 20
    v = [np.ones(1)] * 40
    y = np.array([1.0, -1.0] * 20)
    w = quality.descend(x, v, y, 2)
    assert w[0] + w[2] > 0.9 and w[1] + w[2] < -0.9


def brute_indicators(text):
    """Indices by the definition, a gram at a time."""
    from clonemesh.llm.scan import U, mix, rolling, words
    import pyarrow as pa

    raw, bits, out = text.encode(), quality.BITS, set()
    mask = (1 << 64) - 1
    for n in (1, 2, 3):
        for i in range(len(raw) - n + 1):
            x = int.from_bytes(raw[i : i + n], "big") + (n << 40)
            out.add((x * 0x9E3779B97F4A7C15 & mask) >> (64 - bits))
    ws = raw.split()
    code = []
    for i, w in enumerate(ws):
        up, low, dig, far = (sum(f(c) for c in w) for f in (lambda c: 65 <= c <= 90, lambda c: 97 <= c <= 122, lambda c: 48 <= c <= 57, lambda c: c >= 128))
        last = w[-1]
        last = 97 if last >= 128 or 97 <= last <= 122 else 65 if 65 <= last <= 90 else 48 if 48 <= last <= 57 else last
        letters = up + low + far
        case = 3 if not letters else 2 if not low and up else 1 if 65 <= w[0] <= 90 else 0
        size = min(int(np.ceil(np.log2(len(w) + 1))), 7)
        same = 1 if i >= 1 and ws[i - 1] == w else 2 if i >= 2 and ws[i - 2] == w else 0
        mixed = (dig > 0) * 2 + (letters + dig < len(w) - 1)
        code.append((((last * 4 + case) * 8 + size) * 3 + same) * 4 + mixed)
    shape = mix(np.array(code, U) + U(0x5EED)) if code else np.zeros(0, U)
    hashes = np.array([next(iter(words(pa.array([w.decode()])))).h[0] for w in ws], U)
    for own, most, base in ((shape, 3, 0), (hashes, 2, 1 << bits)):
        for n in range(1, most + 1):
            for i in range(len(own) - n + 1):
                out.add(int(rolling(own[i : i + n], n)[0] >> U(64 - bits)) + base)
    return sorted(out)


def test_indicators_are_those_of_brute_force():
    import pyarrow as pa

    texts = ["", "a", "The the the CAT, sat 12 a1! é", "x  y\tx y z", "UPPER lower Mixed. 3.14 -- a a b a"]
    got = [x.tolist() for target in (1, 1 << 20) for w in quality.words(pa.array(texts), target=target) for x in quality.features(w)]
    assert got == [brute_indicators(t) for t in texts] * 2
    for x in (np.arange(5), np.arange(0, quality.DIM, 3)):
        raw = quality._packed(x)
        assert (quality._unpacked(raw) == x).all() and len(raw) <= quality.DIM // 8


def test_ratios():
    count = np.zeros((2, quality.DIM))
    count[:, 0], count[:, 1], count[:, 2] = (8, 2), (0, 4), (1, 1)
    r = quality.log_ratio(count)
    p, q = count[1] + 1, count[0] + 1
    assert r[0] == pytest.approx(np.log((3 / p.sum()) / (9 / q.sum()))) and r[1] == pytest.approx(np.log((5 / p.sum()) / (1 / q.sum())))
    assert (r[2:] == 0).all()


def test_descent_solves_the_dual_problem():
    """On a small problem the primal value is that of the dual: no better weights exist."""
    r = np.random.default_rng(0)
    n, dim, c = 40, 12, 1.0
    xs = [np.sort(r.choice(dim, 5, replace=False)) for _ in range(n)]
    vals = [r.normal(size=5) for _ in range(n)]
    y = np.where(r.random(n) < 0.5, 1.0, -1.0)
    w = quality.descend(xs, vals, y, dim, c, epochs=20_000)
    full = np.zeros((n, dim + 1))
    for i, (x, v) in enumerate(zip(xs, vals)):
        full[i, x], full[i, -1] = v, 1.0
    primal = w @ w / 2 + c * np.maximum(0, 1 - y * (full @ w)).sum()
    best = primal
    a = np.zeros(n)
    q = (full * y[:, None]) @ (full * y[:, None]).T
    for _ in range(4000):  # projected gradient on the dual
        a = np.clip(a - (q @ a - 1) / np.linalg.norm(q, 2), 0, c)
    assert best == pytest.approx(a.sum() - a @ q @ a / 2, rel=2e-2) and best >= a.sum() - a @ q @ a / 2 - 1e-6


def test_long_texts_and_repeated_ids(spark, labelled):
    docs, labels = labelled
    more = spark.createDataFrame([(5000, "good words here " * 80_000), (5000, "BAD!! " * 10), (1, "OTHER!! TEXT!!")], "doc_id long, text string")
    got = quality.classify(docs.union(more), labels).collect()
    assert len(got) == 407 and len([r for r in got if r.doc_id == 5000]) == 2 and all(0 <= r.score <= 1 for r in got)


def test_labels_without_documents(spark, labelled):
    docs, labels = labelled
    far = labels.withColumn("doc_id", labels.doc_id + 1_000_000)
    assert len({r.score for r in quality.classify(docs, far).collect()}) == 1
