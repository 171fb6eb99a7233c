"""Every training-data query with SQL gives the SQL's rows on the smallest tables; the others run."""

import pytest

from adstrata.llm import queries
from tests.oracle import compared

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    if name in queries.SQL:
        ours, theirs = compared(spark, DIR, queries.QUERIES[name], queries.SQL[name])
        assert ours == theirs
    else:
        queries.QUERIES[name](spark, DIR).collect()
