import os

import pytest

from lodegraph.llm import queries as llm
from tests.compare import rows, sql_rows, tables

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_query(spark, name):
    cols, got = rows(llm.queries()[name](spark, DATA))
    sql = llm.oracle_sql().get(name)
    if sql is not None:
        assert (cols, got) == sql_rows(tables(DATA), sql)
