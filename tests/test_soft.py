"""Soft memberships in rounds of joins equal the dense code."""

from __future__ import annotations

import random

import numpy as np

from clonemesh.operators import graph, soft


def edges(spark):
    r = random.Random(9)
    rows = [(f"n{i:02d}", f"n{j:02d}", round(0.5 + r.random(), 3)) for i in range(16) for j in range(i + 1, 16) if r.random() < (0.8 if i // 8 == j // 8 else 0.08)]
    return spark.createDataFrame(rows, "tcr_id_a string, tcr_id_b string, final_score double")


def values(df):
    return {r.tcr_id: np.array(r.f) for r in df.collect()}


def test_affiliations_are_those_of_dense_code(spark, monkeypatch):
    d = edges(spark)
    want = values(graph.bigclam(d, 2, rounds=4, rate=0.05))
    monkeypatch.setattr(graph, "DENSE", 5)
    got = values(graph.bigclam(d, 2, rounds=4, rate=0.05))
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


def test_eigenvectors_are_those_of_dense_code(spark):
    d = edges(spark)
    want = values(graph.spectral_soft(d, 1))
    got = {r.node: np.array(r.f) for r in soft.spectral_rows(soft.both_ways(d), 1, rounds=12, steps=4, tolerance=1e-6).collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=2e-2) for k in want)


def test_more_vectors_than_nodes_and_repeated_edges(spark):
    d = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("a", "a", 9.0), ("b", "c", 2.0)], "tcr_id_a string, tcr_id_b string, final_score double")
    both = {(r.node, r.nbr): r.w for r in soft.both_ways(d).collect()}
    assert both == {("a", "b"): 2.0, ("b", "a"): 2.0, ("b", "c"): 2.0, ("c", "b"): 2.0}
    rows = soft.spectral_rows(soft.both_ways(d), 4, rounds=3).collect()
    assert len(rows) == 3 and all(len(r.f) == 4 and r.f[3] == 0.0 for r in rows)
