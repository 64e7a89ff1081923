"""Every named query against its SQL counterpart on the smallest sample."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import compare  # noqa: E402
from runlens.catalog import ORACLE_SQL, QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables not present")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, name):
    columns, got = compare.spark_rows(spark, FOLDER, name)
    if name in ORACLE_SQL:
        assert (columns, got) == compare.oracle(FOLDER, ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
