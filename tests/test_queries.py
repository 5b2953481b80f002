"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

from .oracle import compare

D = "/root/testdata/sf0.001"
LLM = {k for m in entry.PARTS if "llm" in m.__name__ for k in m.queries()}
NAMES = sorted(k for k in entry.oracle_sql() if k not in LLM)


@pytest.mark.skipif(not os.path.isdir(D), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    got, want = compare(spark, D, name, entry.queries()[name], entry.oracle_sql()[name])
    assert got == want


def test_entry(spark):
    if os.path.isdir(D):
        assert entry.entry(spark).count() > 0
