from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from clonemesh.llm import grace


def brute(rows):
    """(doc_id, keep_id, group_size, kept, sha) as a sorted list."""
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(re.sub("[ \t-\r]", "", t or ""), []).append((-len(t or ""), i is None, i, k))
    out = []
    for x, g in groups.items():
        best = min(g)
        out += [(i, best[2], len(g), k == best[3], hashlib.sha256(x.encode()).hexdigest()) for _, _, i, k in g]
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("limit", [grace.TABLE_BYTES, 20_000])
def test_groups_are_those_of_brute_force_at_any_table_size(clashing, corpus, limit):
    rows = [c[:2] for c in corpus]
    assert got(grace.exact_groups(clashing, limit)) == brute(rows)


def test_repeated_rows_ties_and_missing_ids(spark):
    rows = [(5, "a b"), (5, "a b"), (5, "ab "), (None, "a\tb "), (None, "a b "), (2, "ab"), (7, None), (8, " \n"), (9, ""), (None, None), (10, "\x00"), (11, " "), (12, "é"), (13, "é"), (12, "x" * 100_000), (3, "x" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert got(grace.exact_groups(df, 20_000)) == want
    kept = grace.drop_exact(df.withColumns({"kept": F.lit(1), "_cm_id": F.lit("z")}), 20_000)
    assert kept.columns == ["doc_id", "text", "kept", "_cm_id"]
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(w[0]) for w in want if w[3])
    assert {r.text for r in kept.collect() if r.doc_id == 3} == {"x" * 100_000}


def test_a_group_of_a_third_of_the_rows_sends_a_record_for_each_task(spark):
    df = spark.range(0, 3000, 1, 6).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    rows = [(i, "the same text" if i % 3 == 0 else f"t{i}") for i in range(3000)]
    assert got(grace.exact_groups(df)) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, rank int")
    assert got(grace.exact_groups(df)) == []
    assert grace.drop_exact(df).collect() == [] and grace.drop_exact(df).columns == df.columns


def test_table_compares_whole_contents():
    t = grace.OpenTable(10_000)
    for k in range(200):
        assert t.find(7, b"%d" % k) == -1  # all have one hash
        assert t.add(7, b"%d" % k) == k
    assert [t.find(7, b"%d" % k) for k in range(200)] == list(range(200))
    assert t.full


def test_what_does_not_fit_is_spilled_to_further_levels(spark, monkeypatch):
    levels = []
    real = grace.written
    monkeypatch.setattr(grace, "written", lambda df, name: levels.append(name) or real(df, name))
    rows = [(i, "x" * 900 + str(i % 240)) for i in range(360)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert got(grace.exact_groups(df, 6_000)) == brute(rows)
    assert "level1" in levels
