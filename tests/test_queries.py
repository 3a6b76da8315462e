"""Every registered query against its SQL on the smallest data set."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import connect, difference


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sf_dir, db, name):
    df = queries()[name](spark, sf_dir)
    if name in oracle_sql():
        assert difference(df, db, oracle_sql()[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry(spark).columns == ["query_id", "project", "name", "similarity", "rank"]


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
