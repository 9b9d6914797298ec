import os

import pytest

from lodegraph.plans import catalog
from tests.compare import rows, sql_rows, tables

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.fixture(scope="module")
def con():
    return tables(DATA)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_agrees_with_sql(spark, con, name):
    cols, got = rows(catalog.queries()[name](spark, DATA))
    sql = catalog.oracle_sql().get(name)
    if sql is not None:
        assert (cols, got) == sql_rows(con, sql)


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
