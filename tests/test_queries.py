import pytest

import __spark_entry__ as entry
from check_queries import compare, connect

FOLDER = "/root/testdata/sf0.001"


def test_every_query_has_its_sql():
    # The corpus operators have tests of their own.
    assert set(entry.QUERIES) == set(entry.ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    assert compare(spark, connect(FOLDER), name, FOLDER) == []
