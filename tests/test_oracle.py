"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
import compare

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    return compare.oracle_connection(SMALL)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, oracle, name):
    assert compare.difference(spark, oracle, name, SMALL) in (None, "no rows")


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
