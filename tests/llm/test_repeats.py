from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from clonemesh.llm import repeats, scan


def split(t):
    return (t or "").encode().split()


def brute_removed(rows, size):
    first = {}
    top = 1 << 62
    for i, t in sorted((top if i is None else i, t or "") for i, t in rows):
        w = split(t)
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), i)
    out = {}
    for i, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < (top if i is None else i):
                gone[k : k + size] = [True] * size
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("size", [7, 13])
def test_removal_is_that_of_brute_force(docs, corpus, size):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(docs, size).collect()}
    assert got == brute_removed([c[:2] for c in corpus], size)
    assert any(v[1] for v in got.values())


def test_text_is_kept_or_joined(clashing, corpus):
    out = repeats.remove_repeats(clashing, keep_text=True)
    assert out.columns == clashing.columns
    want = brute_removed([c[:2] for c in corpus], 13)
    for r in out.collect():
        if want[r.doc_id][1] == 0:
            assert r.text == next(c[1] for c in corpus if c[0] == r.doc_id)
        else:
            assert hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id][2] and r.n_chars == len(r.text)


def test_spans_are_those_of_brute_force(docs, corpus):
    size, where = 30, {}
    for i, t in [c[:2] for c in corpus]:
        w = split(t)
        for k in range(len(w) - size + 1):
            where.setdefault(tuple(w[k : k + size]), set()).add(i)
    want = set()
    for i, t in [c[:2] for c in corpus]:
        w = split(t)
        m = [False] * (len(w) + 1)
        for k in range(len(w) - size + 1):
            if len(where[tuple(w[k : k + size])]) > 1:
                m[k : k + size] = [True] * size
        a = None
        for k, x in enumerate(m):
            if x and a is None:
                a = k
            if not x and a is not None:
                want.add((i, a, k))
                a = None
    got = repeats.repeated_spans(docs, size).collect()
    assert {(r.doc_id, r.start_word, r.end_word) for r in got} == want and want
    assert {r.doc_id for r in got if r.first} >= {100, 200}


def test_small_cases(spark, docs):
    assert repeats.remove_repeats(docs.limit(0)).count() == 0
    assert repeats.repeated_spans(docs.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")] * 3, "doc_id long, text string")
    assert {r.n_removed for r in repeats.remove_repeats(same).collect()} == {0}
    with pytest.raises(ValueError):
        repeats.remove_repeats(docs, 5)


@pytest.mark.parametrize("anchors", [repeats.cover_anchors, repeats.minimiser_anchors])
def test_every_window_has_an_anchor_wherever_it_stands(anchors):
    r = random.Random(4)
    size, reach = (13, 6) if anchors is repeats.cover_anchors else (50, 11)
    common = [f"w{r.random()}" for _ in range(size)]
    import pyarrow as pa

    texts = [" ".join([f"p{r.random()}" for _ in range(k)] + common + [f"q{r.random()}" for _ in range(9)]) for k in range(15)]
    seen = []
    for w in scan.words(pa.array(texts)):
        h, p = anchors(w, size)
        for i in range(w.r1 - w.r0):
            start = w.first[i] + w.r0 + i
            own = (p >= start) & (p <= start + reach)
            seen.append(set(h[own].tolist()))
    assert all(a & b for a in seen for b in seen)


def test_scan_hashes_equal_words_equally():
    import pyarrow as pa

    texts = ["b a  a\tb", None, "", "a" * 70000 + " a b", "é a"]
    got = [w for part in (1, 1 << 20) for w in scan.words(pa.array(texts), target=part)]
    by = {}
    for w in got:
        for i in range(w.r1 - w.r0):
            for k in range(w.first[i], w.first[i + 1]):
                by.setdefault(bytes(w.data[w.starts[k] : w.ends[k]]), set()).add(int(w.h[k]))
    assert all(len(v) == 1 for v in by.values()) and len(set.union(*by.values())) == len(by) == 4
    assert np.array_equal(scan.rolling(np.arange(5, dtype=np.uint64), 9), np.zeros(0))


def test_suffixes_are_sorted_by_their_words():
    r = np.random.default_rng(3)
    codes = r.integers(0, 3, 400).astype(np.uint64)
    at = np.sort(r.choice(380, 150, replace=False))
    for depth in (1, 4, 12):
        order, common = repeats.suffix_array(codes, at, depth)
        rows = [tuple(codes[p : p + depth].tolist()) for p in at[order]]
        assert rows == sorted(rows) and sorted(order.tolist()) == list(range(len(at)))
        for k in range(1, len(rows)):
            same = 0
            while same < depth and rows[k][same] == rows[k - 1][same]:
                same += 1
            assert common[k] == same
    assert len(repeats.suffix_array(codes, np.zeros(0, np.int64), 5)[0]) == 0


def test_rows_without_an_id_and_of_one_id(spark):
    """Rows of one id are one document whatever their texts, and all rows without one are the last."""
    run = " ".join(f"w{i}" for i in range(60))
    rows = [(5, run + " a"), (5, "b " + run), (None, run), (None, "c " + run + " d"), (7, "e " + run)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 99, r.n_words, r.n_removed) for r in repeats.remove_repeats(d).collect())
    assert got == [(5, 61, 0), (5, 61, 0), (7, 61, 60), (99, 60, 60), (99, 62, 60)]
    spans = sorted((r.doc_id or 99, r.start_word, r.end_word, r.first) for r in repeats.repeated_spans(d).collect())
    assert spans == [(5, 0, 60, True), (5, 1, 61, True), (7, 1, 61, False), (99, 0, 60, False), (99, 1, 61, False)]


def test_texts_beyond_a_batch_and_clashing_columns(spark, clashing):
    r = random.Random(9)
    long = " ".join(f"w{r.randrange(900)}" for _ in range(400_000))  # over 1 MB, blocks are cut at 1 MB
    part = " ".join(long.split()[200_000:200_100])
    d = spark.createDataFrame([(1, part), (2, long)], "doc_id long, text string")
    got = {x.doc_id: x.n_removed for x in repeats.remove_repeats(d).collect()}
    assert got == {1: 0, 2: 100}
    assert {(x.doc_id, x.start_word, x.end_word) for x in repeats.repeated_spans(d).collect()} == {(1, 0, 100), (2, 200_000, 200_100)}
    assert repeats.repeated_spans(clashing).count() == repeats.repeated_spans(clashing.select("doc_id", "text")).count()
