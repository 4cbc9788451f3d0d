"""Every query against its SQL on the smallest tables."""

import os

import pytest

import tools_compare as C
from treeline import disk_queries, problem_queries, tree_queries

FOLDER = f"{C.DATA}/sf0.001"
QUERIES = {**problem_queries.QUERIES, **tree_queries.QUERIES, **disk_queries.QUERIES}
SQL = {**problem_queries.SQL, **tree_queries.SQL, **disk_queries.SQL}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return C.tables(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    cols, got = C.spark_rows(QUERIES[name](spark, FOLDER))
    if name in SQL:
        head, want = C.sql_rows(con, SQL[name])
        assert cols == head and got == want


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
