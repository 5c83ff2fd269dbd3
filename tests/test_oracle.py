"""Every registered query against its SQL twin on the driver's tables."""

import os

import pytest

from plumbline import registry
from tests.oracle import compare, connect

registry.load_all()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_answer(spark, con, name):
    assert name in registry.ORACLE
    assert compare(spark, con, registry.QUERIES[name], registry.ORACLE[name], SF_DIR) is None


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    flagship = entry.entry(spark)
    assert flagship.columns == [
        "check", "table_name", "column_name", "issue_type", "n_bad", "n_rows", "rate", "example", "confidence",
    ]
    assert flagship.count() > 0
