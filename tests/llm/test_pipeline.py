from __future__ import annotations

import corpus_pipeline
from clonemesh.llm import minhash, queries, repeats

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols, n = docs.columns, docs.count()
    for name, f in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.written(f(spark, docs, SF), name)
        assert docs.columns == cols and 0 < docs.count() <= n
        if name == "near_dedup":
            kept = {r.doc_id for r in minhash.near_duplicates(before, 80).where("kept").collect()}
            assert {r.doc_id for r in docs.select("doc_id").collect()} == kept
        if name == "substring_dedup":
            assert repeats.remove_repeats(docs).agg({"n_removed": "sum"}).first()[0] <= repeats.remove_repeats(before).agg({"n_removed": "sum"}).first()[0]
            assert docs.count() == before.count()
        n = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == n and out.where("exact").count() == n
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == {r.doc_id for r in out.collect()}


def test_registered_queries():
    names = sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))


def odd(spark):
    from pyspark.sql import functions as F

    r = [f"w{i}" for i in range(80)]
    text = " ".join(r)
    rows = [(1, text, "en", "a", 9), (2, text + " tail", "en", "a", 9), (2, " ".join(r[:20]) + " other words " * 9, None, None, None)]
    rows += [(3, None, "en", "a", None), (4, "", None, "b", 0), (None, text, "de", "b", 9), (5, "long " * 260_000, "en", "a", 9)]
    rows += [(6, "x " + " ".join(r[10:40]) + " y", "en", "b", 9)] * 2 + [(7, "short", "en", "b", 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return d.withColumns({c: F.lit("x") for c in ("key", "rep", "hub", "score", "batch", "tokens", "root", "topic_")})


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, repeated ids and rows, clashing columns, empty tables."""
    d = odd(spark)
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, d, SF)
        assert out.columns == d.columns and f(spark, d.limit(0), SF).count() == 0
        got = sorted(((r.doc_id or 0), r.text or "") for r in out.collect())
        had = sorted(((r.doc_id or 0), r.text or "") for r in d.collect())
        if name == "near_dedup":
            gone = [x for x in had if x not in got]
            assert [i for i, t in gone] == [2] and gone[0][1].endswith("tail") and len(got) == len(had) - 1
        if name == "substring_dedup":
            texts = {}
            for i, t in got:
                texts.setdefault(i, []).append(t)
            assert len(got) == len(had) and sorted(texts[2]) == ["other words " * 9, "tail"] or sorted(t.strip() for t in texts[2]) == [("other words " * 9).strip(), "tail"]
            assert texts[6] == ["x y"] * 2 and texts[0] == [""] and texts[5] == ["long " * 260_000]
    out = corpus_pipeline.tokens(spark, d, SF)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "token_ids", "n_tokens", "decoded_sha256", "exact"]
    assert out.count() == d.count() and corpus_pipeline.tokens(spark, d.limit(0), SF).count() == 0


def test_quality_stage_is_the_classifiers_decision(spark):
    from clonemesh.llm import quality
    from clonemesh.llm.common import table

    docs = table(spark, SF, "documents")
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, SF).select("doc_id").collect()}
    assert kept == {r.doc_id for r in quality.classify(docs, table(spark, SF, "labels")).where("score >= 0.3").collect()}


def test_mixing_stage_is_the_calibrated_draw(spark):
    """Kept rows are those whose hash is below a probability raked by plain Python."""
    import hashlib

    from clonemesh.llm import mixing
    from clonemesh.llm.common import table
    from test_mixing import brute_rake

    docs = table(spark, SF, "documents")
    rows = [tuple(r) for r in mixing.described(docs).select("doc_id", "_cm_source", "_cm_lang", "_cm_topic", "_cm_tokens").collect()]
    cells = {}
    for _, *k, n in rows:
        cells[tuple(k)] = cells.get(tuple(k), 0) + n
    w = brute_rake(cells, 0.5, mixing.ROUNDS)
    top = max(w[k] / cells[k] for k in cells)
    u = lambda i: int(hashlib.md5(f"mix1:{i}".encode()).hexdigest()[:8], 16) / 2**32
    want = {i for i, *k, _ in rows if u(i) < w[tuple(k)] / cells[tuple(k)] / top}
    assert {r.doc_id for r in corpus_pipeline.mixing(spark, docs, SF).select("doc_id").collect()} == want
