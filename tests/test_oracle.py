"""Every named query against its SQL twin on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import compare
import pytest

from repopulse.catalog import QUERIES, oracle_sql

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def database():
    return compare.connect(SF_DIR)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, database, name):
    found = compare.spark_rows(QUERIES[name](spark, SF_DIR))
    assert compare.differences(found, compare.sql_rows(database, oracle_sql()[name])) is None
