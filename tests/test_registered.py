"""Registered queries against their SQL twins on the smallest tables: every fifth one, or all with ALL_QUERIES=1."""

import os

import pytest

import __spark_entry__ as entry
from workload import check

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.duck(SMALL)


NAMES = [n for n in entry.queries() if n in entry.oracle_sql()]
NAMES = NAMES if os.environ.get("ALL_QUERIES") else NAMES[::5]


@pytest.mark.parametrize("name", NAMES)
def test_equals_twin(spark, con, name):
    ok, note = check.compare(spark, con, SMALL, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


def test_entry(spark):
    r = entry.entry(spark).first()
    assert r.stores == 150 and 0 <= r.share_at_threshold <= 1


def test_twins_only_name_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
