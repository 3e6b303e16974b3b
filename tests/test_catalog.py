"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

from __future__ import annotations

import math

import pytest

from clonemesh import catalog

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("part", "events"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _rows(table):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return (0, "")
        return (1, v) if isinstance(v, str) else (2, str(v)) if isinstance(v, bool | list) else (3, str(round(float(v), 9) + 0.0))

    cols = sorted(table.column_names)
    return sorted(tuple(plain(v) for v in row) for row in zip(*(table.column(c).to_pylist() for c in cols))), cols


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, name):
    got, cols = _rows(catalog.queries()[name](spark, SF).toArrow())
    want, want_cols = _rows(duck.sql(catalog.oracle_sql()[name]).to_arrow_table())
    assert cols == want_cols
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    d = __spark_entry__.entry(spark)
    assert d.columns == ["cluster_id", "size", "confidence"]
    assert d.count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
