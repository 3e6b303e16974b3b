from __future__ import annotations

import pytest

from clonemesh.llm import mixing

duckdb = pytest.importorskip("duckdb")


def brute_rake(cells, alpha, rounds):
    total = sum(cells.values())
    w = {k: v / total for k, v in cells.items()}
    target = []
    for d in range(3):
        s = {}
        for k, v in cells.items():
            s[k[d]] = s.get(k[d], 0) + v
        p = {x: (v / total) ** alpha for x, v in s.items()}
        target.append({x: v / sum(p.values()) for x, v in p.items()})
    for _ in range(rounds):
        for d in range(3):
            s = {}
            for k, v in w.items():
                s[k[d]] = s.get(k[d], 0) + v
            w = {k: v * target[d][k[d]] / s[k[d]] for k, v in w.items()}
    return w


def test_weights_are_those_of_brute_force(spark):
    cells = {("a", "x", "p"): 100, ("a", "y", "q"): 30, ("b", "x", "q"): 50, ("b", "y", "p"): 7, ("b", "y", "q"): 3}
    t = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, tokens long").coalesce(1)
    got = mixing.raked_in_one_task(t, 0.5, 0.6, 8).collect()
    want = brute_rake(cells, 0.5, 8)
    for r in got:
        assert r.weight == pytest.approx(want[r.source, r.lang, r.topic])
        assert 0 < r.probability <= 1
    assert sum(r.probability * cells[r.source, r.lang, r.topic] for r in got) == pytest.approx(0.6 * 190)


def test_rows_are_those_of_sql(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(c.sql(mixing.mixture_sql()).fetchall())
    got = sorted(tuple(r) for r in mixing.mixture(docs).collect())
    assert got == want and 0 < len(got) < docs.count()


def marginals(rows):
    """By dimension, the share of each value in the (source, lang, topic, tokens) rows."""
    total, out = sum(r[3] for r in rows), [{}, {}, {}]
    for r in rows:
        for d in range(3):
            out[d][r[d]] = out[d].get(r[d], 0) + r[3] / total
    return out


def targets(rows, alpha=0.5):
    out = []
    for m in marginals(rows):
        p = {x: v**alpha for x, v in m.items()}
        out.append({x: v / sum(p.values()) for x, v in p.items()})
    return out


def test_the_reachable_share_meets_the_targets(spark):
    docs = mixing.described(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    raked, few = mixing.raked_cells(docs, 0.5, None, mixing.ROUNDS)
    assert few
    cells = {tuple(r)[:3]: r[3] for r in docs.groupBy("_cm_source", "_cm_lang", "_cm_topic").agg({"_cm_tokens": "sum"}).collect()}
    raked = raked.collect()
    assert max(r.probability for r in raked) == pytest.approx(1) and len(raked) == len(cells)
    got = marginals([(r.source, r.lang, r.topic, r.probability * cells[r.source, r.lang, r.topic]) for r in raked])
    for g, t in zip(got, targets([(*k, v) for k, v in cells.items()])):
        assert g == pytest.approx(t, abs=2e-3)


def test_the_stage_of_the_pipeline_meets_the_targets(spark):
    import corpus_pipeline

    rows = [(i, "word " * 40 if i % 50 else "1234 " * 40, "en" if i % 10 else "de", f"s{min(i % 7, 1)}", 200) for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.mixing(spark, docs, "")
    cells = lambda d: [tuple(r) for r in mixing.described(d).select("_cm_source", "_cm_lang", "_cm_topic", "_cm_tokens").collect()]
    for g, t in zip(marginals(cells(kept)), targets(cells(docs))):
        assert g == pytest.approx(t, abs=0.03)


def test_columns_nulls_and_empty(clashing, docs):
    kept = mixing.sample_mixture(clashing, share=1.0)
    assert kept.count() == clashing.count()
    assert [c for c in kept.columns if not c.startswith("_cm_")] == clashing.columns
    assert mixing.mixture(docs.limit(0)).count() == 0
    assert mixing.mixture(docs.where("text is null"), share=1.0).first().tokens == 1


def test_no_python_on_the_main_path(docs):
    plan = mixing.mixture(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_given_targets_are_met(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    goal = {"lang": {"en": 1, "de": 3, "xx": 5}, "topic": {"article": 0.5, "long": 0.5}}
    rows = mixing.marginals(docs, targets=goal, rounds=40).collect()
    got = {(r.dimension, r.value): r for r in rows}
    assert got["lang", "en"].kept == pytest.approx(0.25, abs=1e-6) and got["lang", "de"].raked == pytest.approx(0.75, abs=1e-6)
    assert got["topic", "article"].kept == pytest.approx(0.5, abs=1e-6) and got["topic", "table"].kept == got["lang", "fr"].kept == 0
    kept = {(r.lang, r.topic) for r in mixing.mixture(docs, targets=goal).select("lang", "topic").distinct().collect()}
    assert kept and kept <= {(x, y) for x in ("en", "de") for y in ("article", "long")}
    assert mixing.mixture(docs, targets={"lang": {}}).count() == 0


@pytest.mark.parametrize("share", [None, 0.8])
def test_many_cells_are_raked_alike(spark, monkeypatch, share):
    docs = mixing.described(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    few, _ = mixing.raked_cells(docs, 0.5, share, 2, {"lang": {"en": 1, "de": 2}})
    want = {tuple(r)[:3]: r for r in few.collect()}
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 1)
    many, is_few = mixing.raked_cells(docs, 0.5, share, 2, {"lang": {"en": 1, "de": 2}})
    assert not is_few
    for r in many.collect():
        w = want.pop(tuple(r)[:3])
        assert (r.weight, r.probability) == pytest.approx((w.weight, w.probability), rel=1e-9, abs=1e-12)
    assert not want


def test_ties_and_repeated_rows(spark):
    rows = [(i, "word " * 50, "en", f"s{i % 2}") for i in range(4000)]
    rows += [(7, "other text", "en", "s1")] * 3 + [(None, "no id", None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = mixing.mixture(docs, targets={"source": {"s0": 1, "s1": 1}}).collect()
    p = {r.source: r.probability for r in kept if r.topic == "brief" and r.tokens > 10}
    assert p["s0"] == pytest.approx(p["s1"], rel=0.02) and "(none)" not in p
    assert len([r for r in kept if r.doc_id == 7 and r.tokens < 10]) in (0, 3)
