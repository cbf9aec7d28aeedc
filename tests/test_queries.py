"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

from catalog import all_queries
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(all_queries()))
def test_query(spark, con, name):
    query, sql = all_queries()[name]
    ok, note = compare(query(spark, SF), sql, con)
    assert ok, note
