"""Every query with a SQL check gives the SQL's rows on the smallest test set."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, sf, name):
    _, problem = compare(spark, con, name, sf)
    assert problem == ""


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["gene", "mean", "dispersion", "bin", "z", "rank"]
