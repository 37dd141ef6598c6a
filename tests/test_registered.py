import glob

import pytest

import __spark_entry__ as contract
from echometer.checks.oracle import ORACLE
from echometer.checks.queries import QUERIES
from tests.compare import difference

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not glob.glob(f"{SF}/*.parquet"), reason="test tables missing")


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, name):
    df = contract.queries()[name](spark, SF)
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert difference(df, SF, sql) is None
