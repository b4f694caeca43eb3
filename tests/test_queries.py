"""Every registered query against its SQL twin, at the smallest scale."""

import pytest

import __spark_entry__ as entry_module
from check_oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query(spark, con, name):
    assert compare(spark, con, SF, name) is None


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert 0 < len(rows) <= 10
    scores = [r["safety_score"] for r in rows]
    assert scores == sorted(scores, reverse=True)


def test_every_oracle_belongs_to_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
