"""Every core query with SQL gives the SQL's rows on the smallest tables; the others run and keep their columns."""

import importlib

import pytest

import __spark_entry__ as entry

from .oracle import compared

DIR = "/root/testdata/sf0.001"
QUERIES = {k: f for m in map(importlib.import_module, entry.CORE) for k, f in m.QUERIES.items()}
SQL = {k: s for m in map(importlib.import_module, entry.CORE) for k, s in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in SQL:
        ours, theirs = compared(spark, DIR, QUERIES[name], SQL[name])
        assert ours == theirs
    else:
        df = QUERIES[name](spark, DIR)
        assert df.columns == QUERIES[name](spark, DIR).columns
        df.collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
