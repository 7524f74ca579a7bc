"""Every registered query against its DuckDB oracle at sf0.01 (the driver's gate)."""

import pytest

from conftest import SF001, SF01
from keelson.plans.catalog import ORACLE, QUERIES
from oracle_check import compare, duck_conn


@pytest.fixture(scope="module")
def con():
    return duck_conn(SF01)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    assert name in ORACLE, f"{name} has no oracle SQL"
    res = compare(spark, SF01, name, QUERIES[name], ORACLE[name], con)
    assert res["status"] == "match", res


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(ORACLE) <= set(e.oracle_sql()) <= set(e.queries())
    # Stable schema between two calls.
    assert e.entry(spark).schema == df.schema
    assert SF001 in e.SMOKE_DIR
