"""Every registered query against its SQL on the smallest tables that give it rows; queries without SQL have to run."""

import pytest

import __spark_entry__ as entry
from tallyloom.queries import QUERIES as NAMES
from tools.check import compare

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(NAMES))
def test_query(name, spark, duck, small, larger):
    ok, note = compare(spark, duck, small, name, QUERIES[name], ORACLES.get(name))
    if note.startswith("0 rows"):  # too few events there to alert anyone
        ok, note = compare(spark, larger[1], larger[0], name, QUERIES[name], ORACLES.get(name))
    assert ok, note


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_phrases_search_every_order(spark, small):
    rows = QUERIES["match_offers_from_phrases_whole"](spark, small).collect()
    assert {r.pos // 10 % 5 for r in rows} == set(range(5))
