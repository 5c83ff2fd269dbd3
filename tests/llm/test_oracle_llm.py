"""Queries that SQL can express, against DuckDB."""

import os

import pytest

from plumbline.llm import queries
from tests.oracle import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_answer(spark, name):
    assert compare(spark, connect(SF_DIR), queries.QUERIES[name], queries.ORACLE[name], SF_DIR) is None


def test_a_query_for_each_operator():
    import __spark_entry__ as entry

    numbers = {int(n[2:].split("_")[0]) for n in queries.QUERIES}
    assert numbers == set(range(1, 14))
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())
