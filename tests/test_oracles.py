"""Every registered query equals its oracle on the smallest data."""

from __future__ import annotations

import pytest
from check_oracles import compare
from conftest import SMALL

import __spark_entry__ as entry


def test_every_query_has_an_oracle():
    assert set(entry._queries()) == set(entry.oracles.all_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, key):
    ok, note = compare(spark, SMALL, key)
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() == 10
