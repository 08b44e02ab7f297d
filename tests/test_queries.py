"""Every core query against its SQL on whole tables, and those without SQL for their shape."""

import pytest

from corpusmill.plans import queries

QUERIES, ORACLES = queries.queries(), queries.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_agrees(spark, data, duck, same, name):
    same(QUERIES[name](spark, data).toPandas(), duck.execute(ORACLES[name]).fetchdf())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
