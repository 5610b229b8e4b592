"""Every registered query against its SQL, or for the rest that it runs."""

import pytest
from oracle import compare, connect

from lectern import registry

WITH_SQL = sorted(registry.oracle_sql())
WITHOUT = sorted(set(registry.queries()) - set(WITH_SQL))


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", WITH_SQL)
def test_against_sql(spark, sf_dir, con, name):
    assert compare(registry.queries()[name](spark, sf_dir), con, registry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", WITHOUT)
def test_runs(spark, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    assert df.columns
    df.collect()
