"""Plans are what they should be: no cross joins, columns pruned, filters at the scan."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clonemesh import catalog
from clonemesh.operators import pairs, simjoin
from clonemesh.testviews import WEIGHTS, assign, tcr

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["hamming_pairs", "hamming_pairs_2", "levenshtein_pairs", "coassociation_edges", "signed_edges", "cross_cluster_scores", "pwm_information", "member_labels", "dedup_keep_first", "preprocess_chain", "null_probs"])
def test_no_cross_joins(spark, name):
    p = plan(catalog.queries()[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_scan_reads_what_is_used(spark):
    p = plan(tcr(spark, SF).select("v_beta").where("v_beta = 'TRBV11'"))
    scan = p[p.rindex("ReadSchema") :]
    assert "p_brand" in scan and "p_name" not in scan and "p_size" not in scan
    q = plan(spark.read.parquet(f"{SF}/part.parquet").where("p_size = 3").select("p_partkey"))
    assert "EqualTo(p_size,3)" in q


def test_no_python_in_relational_operators(spark):
    for d in (pairs.coassociation(assign(spark, SF), WEIGHTS), simjoin.levenshtein_pairs(tcr(spark, SF).select(F.col("cdr3_beta").alias("seq")))):
        p = plan(d)
        assert "Python" not in p and "Arrow" not in p


def test_pairs_are_formed_between_signatures(spark):
    """A cluster of interchangeable receptors makes one signature pair, not n^2 join rows."""
    a = spark.range(400).select(F.lit("m").alias("method"), F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("tcr_id"), F.lit("c").alias("cluster_id"))
    e = pairs.coassociation(a)
    assert e.count() == 400 * 399 // 2
    assert pairs.pair_count(a) == 400 * 399 // 2
