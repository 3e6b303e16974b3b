from __future__ import annotations

import random
import re
import zlib

import pytest

from clonemesh.llm import spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def counted(rows, least=7, repeats=2, every=31):
    n = {}
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                n[w] = n.get(w, 0) + 1
    return {w: k for w, k in n.items() if k >= repeats}


def brute(n, ratio=10):
    form, out = {}, []
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
        out.append([w, form[w], None, n[w], len(others), n[form[w]] if form[w] else None])
    for r in out:
        at = r[0]
        while form[at]:
            at = form[at]
        r[2] = at
    return sorted(map(tuple, out))


def rows_of(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    base = ["".join(r.choice("abéÿ") for _ in range(r.randint(6, 12))) for _ in range(60)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(25):
            w = base[min(int(r.expovariate(0.15)), 59)]
            if r.random() < 0.15:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + "b" + w[k:], w[:k] + "Z" + w[k + 1 :]])
            words.append(w.upper() if r.random() < 0.1 and w.isascii() else w)
        rows.append((i if i % 50 else None, r.choice([" ", "9", ", ", "Ā"]).join(words)))
    return [*rows, (1000, None), (1001, ""), (1002, "short words only"), (1003, "z" * 5000), (1003, "z" * 5000), (1004, "z" * 4999), (1005, "z" * 4999)]


def test_counts_and_groups_are_those_of_brute_force(spark, texts):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("word", "n", "gram", "block", "id", "run", "h")}).repartition(3)
    got = {r.word: r.n for r in spelling.word_counts(docs).collect()}
    want = counted(texts)
    assert got == want and len(want) > 150
    rows = rows_of(spelling.spelling_variants(docs))
    assert rows == brute(want)
    assert any(r[1] and r[2] != r[1] for r in rows) or sum(r[1] is not None for r in rows) > 20


def test_hot_blocks_are_split_and_lose_nothing(spark, texts, monkeypatch):
    n = counted(texts, repeats=1)
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    want = brute(n)
    monkeypatch.setattr(spelling, "BLOCK", 8)
    assert rows_of(spelling.variant_groups(words)) == want
    monkeypatch.setattr(spelling, "MOST_GRAMS", 1)
    assert rows_of(spelling.variant_groups(words)) == want


def test_chains_end_at_the_most_frequent(spark):
    words = [("aaaaaaa", 1), ("aaaaaab", 10), ("aaaaabb", 100), ("aaaabbb", 1000), ("aaabbbb", 9999), ("ccccccc", 3), ("ccccccd", 3)]
    got = {r.word: r for r in spelling.variant_groups(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got["aaaaaaa"].root == "aaaabbb" and got["aaaabbb"].form is None and got["aaaabbb"].n_near == 2
    assert got["ccccccc"].form is None and got["ccccccc"].n_near == 1 and got["ccccccc"].form_n is None


def test_ties_go_to_the_smallest_word_and_short_words_are_refused(spark):
    words = [("abcdefg", 1), ("abcdefz", 50), ("abcdefé", 50), ("xbcdefg", 50), ("abcdefgh", 50)]
    got = {r.word: r for r in spelling.variant_groups(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got["abcdefg"].form == "abcdefgh" and got["abcdefg"].n_near == 4
    with pytest.raises(ValueError):
        spelling.near_words(spark.createDataFrame([("abc", 1)], "word string, n long"))


def test_empty(spark):
    assert rows_of(spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string"))) == []
    assert rows_of(spelling.spelling_variants(spark.createDataFrame([(1, None)], "doc_id long, text string"))) == []
