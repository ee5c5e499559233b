import pytest
from compare import assert_same
from conftest import DATA

from ledgerflow.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(name, spark, duck):
    assert_same(catalogue.QUERIES[name](spark, DATA), duck.execute(catalogue.ORACLE_SQL[name]))


def test_every_sql_has_a_query():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
