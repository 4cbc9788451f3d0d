import os

import pytest

import tools_compare as C
from treeline.llm.queries import QUERIES, SQL

FOLDER = f"{C.DATA}/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    cols, got = C.spark_rows(QUERIES[name](spark, FOLDER))
    if name in SQL:
        head, want = C.sql_rows(C.tables(FOLDER), SQL[name])
        assert cols == head and got == want
