from __future__ import annotations

import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from clonemesh.llm import importance

TARGET = [(1, "aa bb Cc deed 99 é"), (2, None), (3, "face CAFE bead")]


def features(t, order):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [" ".join(w[k : k + n]) for n in range(1, order + 1) for k in range(len(w) - n + 1)]


def brute(rows, target, order, buckets, least, share):
    crc = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for _, x in rows:
        for f in features(x, order)[1]:
            s[crc(f)] += 1
    for _, x in target:
        for f in features(x, order)[1]:
            t[crc(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out, able = [], []
    for i, x in rows:
        w, f = features(x, order)
        weight = math.floor(sum(gain[crc(g)] for g in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        row = [i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        out.append(row)
        if len(w) >= least:
            able.append(row)
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: share * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("order,share", [(1, 10), (2, 50), (3, 100)])
def test_rows_are_those_of_brute_force(spark, clashing, corpus, order, share):
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    got = importance.resample(clashing, target, order, 500, 20, share)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = brute([c[:2] for c in corpus], TARGET, order, 500, 20, share)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert sum(r[4] is not None for r in want) > 3


def test_repeated_rows_empty_tables_and_drawn_rows(spark):
    rows = [(1, "w " * 30), (1, "w " * 30), (2, None), (None, "x " * 25), (3, ""), (4, "Z " * 40 + "\U0001d49c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    got = sorted((tuple(r) for r in importance.resample(df, none, share=100).collect()), key=repr)
    want = brute(rows, [], 1, 10_000, 20, 100)
    # equal rows take their ranks in any order
    assert [r[:4] for r in got] == [r[:4] for r in want] and sorted(r[4] or 0 for r in got) == sorted(r[4] or 0 for r in want)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(empty, df).collect() == []
    out = importance.drawn(df.withColumn("score", F.lit("s")), none, share=100)
    assert out.columns == ["doc_id", "text", "score"] and out.count() == 4


def test_lowering_touches_ascii_only(spark):
    got = spark.createDataFrame([("ÀB",), ("AB",), ("İI",), (None,)], "t string").select(importance.lower_ascii(F.col("t")).alias("t"))
    assert [r.t for r in got.collect()] == ["Àb", "ab", "İi", None]
