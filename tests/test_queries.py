import pytest

from citeloom.plans.queries import QUERIES, SQL
from tests.gate import FOLDER, compare, here


MAY_BE_EMPTY = {"anomaly_rings", "list_matches"}


@here
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name])


@here
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    """A query without SQL gives rows, all different where they have an id, with a stable schema."""
    a, b = QUERIES[name](spark, FOLDER), QUERIES[name](spark, FOLDER)
    assert a.schema == b.schema and a.columns
    got = a.collect()
    assert got or name in MAY_BE_EMPTY
    assert sorted(map(repr, got)) == sorted(map(repr, b.collect()))


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


@here
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
