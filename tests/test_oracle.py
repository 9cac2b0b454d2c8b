"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import oracle
from tidemark.plans import QUERIES as OWN

# the corpus queries have tests of their own
QUERIES = {n: q for n, q in entry.queries().items() if n in OWN}
SQL = {n: s for n, s in entry.oracle_sql().items() if n in OWN}
# No part of the smallest table points back at itself through its sizes.
EMPTY_AT_THIS_SIZE = {"g6_stuck_edges", "g6_stuck_parts"}


@pytest.fixture(scope="module")
def con():
    return oracle.connect("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, sf_dir, name):
    problem = oracle.compare(spark, con, sf_dir, name, QUERIES[name], SQL.get(name))
    if name in EMPTY_AT_THIS_SIZE and problem == "empty on both sides":
        problem = None
    assert problem is None, problem


# queries whose joins Catalyst broadcasts at this size: once more as if no side were small
SHUFFLED = tuple(n for n in sorted(QUERIES) if n.startswith((
    "b2_", "c5_", "c6_", "c8_", "c9_", "c10_", "c12_", "c13_", "g1_", "g3_", "g5_", "i8_change_rows", "i17_bulk_created", "i18_bulk_updated",
    "i19_bulk_deleted", "t1_", "t3_", "t7_", "t8_", "v7_", "v8_first_errors")))


@pytest.mark.parametrize("name", SHUFFLED)
def test_matches_sql_without_broadcast(spark, con, sf_dir, name, no_broadcast):
    problem = oracle.compare(spark, con, sf_dir, name, QUERIES[name], SQL.get(name))
    assert problem is None, problem


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
