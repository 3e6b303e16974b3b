from __future__ import annotations

import itertools
import random

import pytest

from clonemesh.llm import components, minhash


def shingles(t, k=5):
    w = bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()).split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, threshold):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_corpus(clashing, corpus):
    got = minhash.near_duplicates(clashing, 80).collect()
    assert len(got) == len(corpus)
    want = brute([c[:2] for c in corpus], 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert want[101][1] == want[102][1] == 99 and want[304][1] == want[305][1] == 303 and want[301][1] == 301


@pytest.mark.parametrize("block", [512, 40])
def test_dense_band_round_the_threshold(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", block)
    r = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for d in range(250):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(300)] = f"x{r.random()}"
        rows.append((d * 3 + 1, " ".join(w)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    want = brute(rows, 85)
    assert got == want and 1 < len({c for _, c in want.values()}) < 250


def test_empty_and_repeated_rows(spark, docs):
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    d = spark.createDataFrame([(5, "a b"), (5, "a b"), (None, "a b"), (None, None)], "doc_id long, text string")
    got = minhash.near_duplicates(d).collect()
    assert sorted((r.doc_id or 0, r.kept) for r in got) == [(0, True), (0, True), (5, True), (5, True)]


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    import corpus_pipeline

    x, y, z = (" ".join(f"{c}{i}" for i in range(40)) for c in "xyz")
    d = spark.createDataFrame([(1, x), (5, x), (5, y), (None, x), (9, z + " more"), (8, z)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.near_duplicates(d, 80).collect())
    assert got == [(0, 0, True), (1, 1, True), (5, 1, False), (5, 5, True), (8, 8, True), (9, 8, False)]
    kept = corpus_pipeline.near_dedup(spark, d, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, x), (1, x), (5, y), (8, z)]


def test_texts_beyond_a_block(spark):
    r = random.Random(4)
    w = [f"w{r.randrange(5000)}" for _ in range(300_000)]  # over 1 MB
    near = w[:150_000] + ["new"] + w[150_001:]
    d = spark.createDataFrame([(3, " ".join(w)), (2, " ".join(near)), (1, " ".join(w[:100_000]))], "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(d, 85).collect()}
    assert got == {3: (len(shingles(" ".join(w))), 2), 2: (len(shingles(" ".join(near))), 2), 1: (len(shingles(" ".join(w[:100_000]))), 1)}


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
