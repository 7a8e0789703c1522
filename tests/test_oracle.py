import pytest

from graphlens.plans import catalogs
from tests.oracle import compare

SQL = catalogs.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    compare(spark, catalogs.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogs.queries()) - set(SQL)))
def test_runs(spark, name):
    assert catalogs.queries()[name](spark, "/root/testdata/sf0.001").count() >= 0
