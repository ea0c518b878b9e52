"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest

from rosterforge.plans import load_all
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load_all()
# Checked by other tests: no SQL twin.
WITHOUT_SQL = {"cluster_vectors"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_only_known_queries_lack_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, duck, name):
    ok, note = compare(spark, duck, name, QUERIES[name], ORACLES.get(name), SF)
    assert ok, note
