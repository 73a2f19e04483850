"""Every registered query against its expected result at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from check import duck, table

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(entry.queries())

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    result = entry.queries()[name](spark, FOLDER).toArrow()
    sql = entry.oracle_sql().get(name)
    assert result.num_rows > 0
    if sql:
        assert table(result) == table(duck(FOLDER).sql(sql).to_arrow_table())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
