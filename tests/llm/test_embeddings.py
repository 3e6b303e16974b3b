from __future__ import annotations

import numpy as np
import pytest

from clonemesh.llm import embedding_dedup as ed


def brute(ids, x, threshold=0.9):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    label = ids.copy()
    while True:
        now = np.minimum(label, np.where(near, label[None, :], 1 << 60).min(axis=1))
        if (now == label).all():
            return near.sum(axis=1), label
        label = now


@pytest.mark.parametrize("blocks", [(1024, 4096), (16, 24)])
def test_links_and_components(spark, monkeypatch, blocks):
    monkeypatch.setattr(ed, "BLOCK", blocks[0])
    monkeypatch.setattr(ed, "QUERIES", blocks[1])
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 24))
    x[100:200] = x[0] + 0.25 * r.normal(size=(100, 24))
    x[200:220] = x[1]
    x = x.astype(np.float32)
    ids = np.arange(300) * 2 + 5
    d = spark.createDataFrame([(int(i), [float(v) for v in row], 1) for i, row in zip(ids, x)], "vec_id long, embedding array<float>, cell int")
    got = {g.vec_id: g for g in ed.near_vectors(d, probes=6).collect()}
    n, c = brute(ids, x.astype(np.float64))
    found = sum(g.n_links for g in got.values())
    assert found >= 0.9 * n.sum() and all(got[i].n_links <= k for i, k in zip(ids, n))
    assert np.mean([got[i].component_id == k for i, k in zip(ids, c)]) > 0.97
    assert all(g.kept == (g.vec_id == g.component_id) for g in got.values())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0]), (10, [1.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0])]
    got = [tuple(r) for r in ed.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    alone = {(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, None)}
    assert set(got) == alone | {(1, 1, 1, True), (2, 1, 1, False), (9, 1, 9, True), (10, 1, 9, False)}
    assert len(got) == len(rows)
    assert ed.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_of_several_lengths(spark, monkeypatch):
    """Two of one length are linked however many there are of another; ties at the threshold count."""
    rows = [(i, [float(i), 1.0, 0.5 * i]) for i in range(4)] + [(10, [1.0, 0.0]), (11, [0.9999, 0.01]), (20, [0.9, (1 - 0.81) ** 0.5, 0.0, 0.0]), (21, [1.0, 0.0, 0.0, 0.0])]
    rows += [(100 + i, [1.0] * (5 + i)) for i in range(12)] + [(200 + i, [2.0] * (4 + i) + [2.1]) for i in range(12)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for lengths in (8, 2):
        monkeypatch.setattr(ed, "MOST_LENGTHS", lengths)
        got = {r.vec_id: (r.n_links, r.component_id) for r in ed.near_vectors(d).collect()}
        want = {}
        for dim in {len(v) for _, v in rows}:
            own = [(i, v) for i, v in rows if len(v) == dim]
            n, c = brute(np.array([i for i, _ in own]), np.array([v for _, v in own]))
            want |= {i: (int(a), int(b)) for (i, _), a, b in zip(own, n, c)}
        assert got == want and got[10] == (1, 10) and got[111] == (1, 111)


def test_clashing_columns(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0], "x", "y", "z"), (2, [1.0, 0.01], "x", "y", "z")], "vec_id long, embedding array<double>, rep string, home string, dim string")
    assert {r.component_id for r in ed.near_vectors(d).collect()} == {1}


def test_recall_on_vectors_without_structure(spark):
    """Pairs at a cosine of 0.90 to 0.93 among vectors that form no clusters, against brute force."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = rng.normal(size=x.shape)
    other -= (other * x).sum(axis=1, keepdims=True) * x
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    c = rng.uniform(0.9001, 0.93, (4000, 1))
    both = np.concatenate([x, c * x + np.sqrt(1 - c**2) * other])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in ed.near_vectors(df).collect()}
    near = both @ both.T >= 0.9
    want = near.sum(axis=1) - 1
    assert all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.99 * want.sum()
