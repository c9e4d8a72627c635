"""Every query with an SQL definition gives the same rows on the small tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import connect, difference

NAMES = sorted(oracle_sql())


@pytest.fixture(scope="module")
def connection(small_dir):
    return connect(small_dir)


def test_every_oracle_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, small_dir, connection, name):
    df = queries()[name](spark, small_dir)
    assert difference(df, connection, oracle_sql()[name]) is None


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0
