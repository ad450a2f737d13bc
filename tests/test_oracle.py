"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    found = entry.queries()[name](spark, SF).toPandas()
    if name in SQL:
        assert compare(found, con.execute(SQL[name]).fetchdf()) == []
    else:
        assert len(found) > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
