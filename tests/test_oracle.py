"""Every registered query against its SQL statement on the smallest test tables."""

import os

import pytest

from tallyworks.catalog import registered

from .oracle import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registered()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    problem, _ = compare(QUERIES[name](spark, FOLDER), duck, SQL[name])
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_statements_have_queries():
    assert set(SQL) <= set(QUERIES)
