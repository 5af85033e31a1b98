"""Every registered query against its SQL on the smallest tables."""

import oracle
import pytest

import __spark_entry__ as entry
from casewright import plans

FOLDER = "/root/testdata/sf0.001"
QUERIES = plans.queries()
ORACLE = plans.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = oracle.connect(FOLDER)
    yield con
    con.close()


def test_every_query_has_an_oracle():
    assert sorted(QUERIES) == sorted(ORACLE)
    assert QUERIES.keys() <= entry.queries().keys() and ORACLE.keys() <= entry.oracle_sql().keys()


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    assert oracle.compare(QUERIES[name](spark, FOLDER), duck, ORACLE[name]) == []
