"""Queries that need no pair as a row give the rows of their SQL where ids are shared, from several
blocks of classes."""

from __future__ import annotations

import pytest
from test_catalog import _rows
from test_shared_votes import larger  # noqa: F401

from clonemesh import catalog
from clonemesh.operators import pairs, votes

duckdb = pytest.importorskip("duckdb")
NAMES = ("cluster_confidence", "gene_overlap", "labeled_pairs", "member_filter", "member_labels", "overlapping_pair_f1", "permutation_null_sizes", "report_sink", "signed_edges", "spectral_step", "tradeoff_sweep")


@pytest.mark.parametrize("name", NAMES)
def test_without_pairs(spark, larger, monkeypatch, name):  # noqa: F811
    monkeypatch.setattr(votes, "BLOCK", 700)
    for f in ("class_edges", "coassociation"):
        monkeypatch.setattr(pairs, f, lambda *a, **k: pytest.fail("pairs were joined"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW part AS SELECT * FROM '{larger}/part.parquet'")
    assert _rows(catalog.queries()[name](spark, larger).toArrow()) == _rows(c.sql(catalog.oracle_sql()[name]).to_arrow_table())


@pytest.mark.parametrize("config", [None, {"split": {"min_consensus_score": 0.3}, "merge": {"min_cross_association": 0.45}, "filter": {"min_member_confidence": 0.26}}])
def test_refined_without_edges(spark, larger, monkeypatch, config):  # noqa: F811
    """Clusters, labels and scores are those of a refinement over all pairs."""
    from pyspark.sql import functions as F

    from clonemesh.operators import refine
    from clonemesh.testviews import WEIGHTS, assign

    a = assign(spark, larger).where("ord < 1000000")
    m = a.where("method = 'vj'").select("cluster_id", "tcr_id")
    e = pairs.scored_edges(a, WEIGHTS).withColumn("final_score", F.round(F.col("weighted_support") / 3, 6))
    want = refine.refine(m, e, config)
    monkeypatch.setattr(votes, "BLOCK", 200)
    got = refine.refine_votes(a, m, WEIGHTS, config, 3)
    six = lambda d: _rows(d.select("cluster_id", "tcr_id", "label", F.round("member_score", 6).alias("s"), F.round("cluster_confidence", 6).alias("c")).toArrow())
    assert six(got) == six(want)


def test_reweighted_without_edges(spark, monkeypatch):
    from clonemesh.plans import stability
    from clonemesh.testviews import WEIGHTS, assign

    a = assign(spark, "/root/testdata/sf0.001")
    got = stability.iterative_reweight(a, WEIGHTS, rounds=2, threshold=1.0)[0]
    monkeypatch.setattr(stability, "MOST", 0)
    assert got == pytest.approx(stability.iterative_reweight(a, WEIGHTS, rounds=2, threshold=1.0)[0], abs=1e-9)


def test_permuted_rows_are_not_broadcast(spark):
    """The driver holds counts of ranges, neither receptors nor labels of the rounds."""
    from clonemesh.operators import nulls

    a = spark.range(500).selectExpr("explode(array('x', 'y')) as method", "concat('t', id) as tcr_id", "concat('c', id % 7) as cluster_id")
    plan = nulls.permuted(a, 2)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("BroadcastExchange") == 2
