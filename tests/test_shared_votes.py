"""Votes of receptors whose rows repeat count as in the SQL, and components need few rounds."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from test_catalog import _rows
from test_shared_ids import large  # noqa: F401

from clonemesh import catalog
from clonemesh.operators import graph, pairs

duckdb = pytest.importorskip("duckdb")
NAMES = ("consensus_balanced", "consensus_coverage", "consensus_conservative", "consensus_high_purity")


@pytest.mark.parametrize("name", NAMES)
def test_shared_ids(spark, large, name):  # noqa: F811
    c = duckdb.connect()
    c.sql(f"CREATE VIEW part AS SELECT * FROM '{large}/part.parquet'")
    assert _rows(catalog.queries()[name](spark, large).toArrow()) == _rows(c.sql(catalog.oracle_sql()[name]).to_arrow_table())


def test_votes_that_repeat(spark):
    """Rows that repeat reach a threshold that clusters alone do not."""
    from clonemesh.operators import consensus

    r = random.Random(3)
    rows = [(m, f"t{i:02d}", f"{m}{r.randrange(12)}") for i in range(60) for m in "xyz" for _ in range(r.choice((1, 1, 1, 2, 6)))]
    a, w = spark.createDataFrame(rows, "method string, tcr_id string, cluster_id string"), {"x": 0.4, "y": 0.3, "z": 0.7}
    for t in (0.6, 0.8, 1.2, 1.5, 2.5):
        want = graph.cluster_members(pairs.scored_edges(a, w, every=True).where(F.col("final_score") >= t - 1e-9))
        got = consensus.balanced(a, w, t - 1e-9, every=True)
        assert sorted(map(tuple, got.members.collect())) == sorted(map(tuple, want.collect()))


def test_thinned_edges(spark, monkeypatch):
    """Edges that repeat what a task knows are not collected."""
    e = spark.range(30_000).selectExpr("concat('n', id % 50) as tcr_id_a", "concat('n', (id * 7) % 40) as tcr_id_b").repartition(3)
    monkeypatch.setattr(graph, "COLLECTED", 3 * 50)
    monkeypatch.setattr(graph, "contract", lambda e: pytest.fail("rounds for a small graph"))
    assert {r.root for r in graph.components(e).collect()} == {r.root for r in graph.components(e.distinct()).collect()}


def test_coarse_communities_without_pairs(spark, large, monkeypatch):  # noqa: F811
    from clonemesh.operators import consensus, leiden

    for m, f in ((consensus, "scored_edges"), (leiden, "_in_rounds"), (leiden, "_in_task")):
        monkeypatch.setattr(m, f, lambda *a, **k: pytest.fail("pairs were made"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW part AS SELECT * FROM '{large}/part.parquet'")
    assert _rows(catalog.queries()["leiden_coarse"](spark, large).toArrow()) == _rows(c.sql(catalog.oracle_sql()["leiden_coarse"]).to_arrow_table())


@pytest.fixture(scope="module")
def larger(tmp_path_factory):
    """2,000 receptors, most of them eleven to an id, so that pairs share several clusters."""
    d = str(tmp_path_factory.mktemp("larger"))
    duckdb.sql(f"COPY (SELECT * REPLACE (CASE WHEN p_partkey < 600 THEN 100000 + p_partkey ELSE 1000000 + p_partkey - 600 END AS p_partkey) FROM '/root/testdata/sf0.01/part.parquet') TO '{d}/part.parquet'")
    return d


@pytest.mark.parametrize("name", ("cluster_split", "cross_cluster_scores", "component_modularity", "edges_sink", "coassociation_matrix", "coassociation_heatmap"))
def test_blocks(spark, larger, monkeypatch, name):
    """From several blocks of classes, with no pairs made by a join."""
    from clonemesh.operators import votes

    monkeypatch.setattr(votes, "BLOCK", 300)
    monkeypatch.setattr(pairs, "class_edges", lambda *a, **k: pytest.fail("pairs were joined"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW part AS SELECT * FROM '{larger}/part.parquet'")
    assert _rows(catalog.queries()[name](spark, larger).toArrow()) == _rows(c.sql(catalog.oracle_sql()[name]).to_arrow_table())


def test_merge_by_votes(spark, larger):
    """Sums between clusters from blocks give the merges of all pairs."""
    from clonemesh.operators import refine, votes
    from clonemesh.testviews import WEIGHTS, assign

    a = assign(spark, larger).where("ord < 1000600")
    m = a.where("method = 'vj'").select("cluster_id", "tcr_id")
    e = pairs.scored_edges(a, WEIGHTS, every=True).withColumn("final_score", F.round(F.col("weighted_support") / 3, 6))
    got = refine.merge_quotient(m, votes.Votes(a, WEIGHTS, every=True).crossed("vj", 3), 0.4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, refine.merge_clusters(m, e, 0.4).collect()))


@pytest.mark.parametrize("chunk", [50, 1 << 20])
def test_affiliation_step_without_pairs(spark, larger, monkeypatch, chunk):
    """Of several blocks and chunks, with receptors whose rows repeat, the step is that of the SQL."""
    from clonemesh.operators import votes

    monkeypatch.setattr(votes, "BLOCK", 600)
    monkeypatch.setattr(votes, "CHUNK", chunk)
    monkeypatch.setattr(pairs, "coassociation", lambda *a, **k: pytest.fail("pairs were joined"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW part AS SELECT * FROM '{larger}/part.parquet'")
    assert _rows(catalog.queries()["affiliation_round"](spark, larger).toArrow()) == _rows(c.sql(catalog.oracle_sql()["affiliation_round"]).to_arrow_table())


def test_pulls_from_blocks(spark):
    """Sums and likelihood over blocks are those over all pairs, with copies in a class."""
    from clonemesh.operators import soft, votes

    r = random.Random(8)
    rows = [(m, f"t{i:03d}", f"{m}{r.randrange(4)}") for i in range(90) for m in "xy"]
    a = spark.createDataFrame(rows, "method string, tcr_id string, cluster_id string")
    both = soft.both_ways(pairs.scored_edges(a, {"x": 0.4, "y": 0.7}).where("final_score >= 0.7"))
    f = soft.begun(both, 3)
    got = votes.Votes(a, {"x": 0.4, "y": 0.7}).pulled(f, 3, 0.7)
    assert _rows(got.toArrow()) == _rows(soft.pulls(both, f, 3).toArrow())


@pytest.mark.parametrize("size", [40, 1 << 21])
@pytest.mark.parametrize("name", ["odd", "shared"])
def test_fused_scores_without_pairs(spark, large, monkeypatch, name, size):  # noqa: F811
    """Threshold and members are those of all pairs and rounds; of odd texts, blank genes, receptors
    that have several rows or none, and several blocks."""
    from clonemesh.operators import consensus, fused, fusion
    from clonemesh.testviews import WEIGHTS, assign, tcr

    if name == "shared":
        a, t = assign(spark, large), tcr(spark, large)
    else:
        r = random.Random(4)
        ids = [f"t{i:02d}" for i in range(80)]
        a = spark.createDataFrame([(m, x, f"{m}{r.randrange(9)}") for x in ids for m in WEIGHTS for _ in range(r.choice((1, 1, 2)))], "method string, tcr_id string, cluster_id string")
        texts = ("CASSF", "CAS", "", None, "CXz\u00e9", "CASSLGQYF")
        t = spark.createDataFrame([(x, r.choice(texts), r.choice(("V1", "V2", "", None)), r.choice(("J1", ""))) for x in ids[2:] for _ in range(r.choice((1, 1, 2)))], "tcr_id string, cdr3_beta string, v_beta string, j_beta string")
    kw = {"tcr": t, "signals": fusion.SIGNALS, "rounds": 3}
    monkeypatch.setattr(consensus, "MOST", 0)
    want = [consensus.balanced(a, WEIGHTS, fdr_q=q, **kw) for q in (0.3, 2.0)]
    monkeypatch.setattr(consensus, "MOST", 4)
    monkeypatch.setattr(fused, "SHARED", size)
    monkeypatch.setattr(fused, "FEW", 30)
    monkeypatch.setattr(fused, "TABLE", 2 if size == 40 else 2048)
    monkeypatch.setattr(consensus, "scored_edges", lambda *a, **k: pytest.fail("pairs were joined"))
    for q, w in zip((0.3, 2.0), want):
        got = consensus.balanced(a, WEIGHTS, fdr_q=q, **kw)
        assert got.threshold == pytest.approx(w.threshold, rel=1e-12)
        assert sorted(map(tuple, got.members.collect())) == sorted(map(tuple, w.members.collect()))
