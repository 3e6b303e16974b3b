"""Queries give the rows of their SQL where keys of a million and more share ids with smaller ones."""

from __future__ import annotations

import pytest
from test_catalog import _rows

from clonemesh import catalog

duckdb = pytest.importorskip("duckdb")
NAMES = ("numbered_clusters", "predicted_clusters", "retention", "made_ids", "vj_support", "overlap_memberships", "community_members", "pwm_information", "vj_enrichment", "expanded_clusters", "receptor_group_clusters", "method_agreement_jaccard", "cluster_features", "raw_confidence", "calibrated_confidence", "analytical_fdr", "divergent_tcrs", "divergence_stats")


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    d = str(tmp_path_factory.mktemp("large"))
    duckdb.sql(f"COPY (SELECT * REPLACE (CASE WHEN p_partkey < 60 THEN 100000 + p_partkey ELSE 1000000 + p_partkey - 60 END AS p_partkey) FROM '/root/testdata/sf0.001/part.parquet') TO '{d}/part.parquet'")
    return d


@pytest.mark.parametrize("name", NAMES)
def test_shared_ids(spark, large, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW part AS SELECT * FROM '{large}/part.parquet'")
    assert _rows(catalog.queries()[name](spark, large).toArrow()) == _rows(c.sql(catalog.oracle_sql()[name]).to_arrow_table())
