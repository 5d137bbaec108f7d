"""Every registered query equals its DuckDB oracle SQL (sf0.001 here; the
driver runs the same comparison at sf0.01)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF001
from tools.oracle_check import compare, duck_views

QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck_views(SF001)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], SF001) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF001).count() > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and set(df.columns) == {"bucket_lo", "bucket_hi", "n_rows", "n_label_tokens"}
