"""Every catalogue query against its SQL in DuckDB."""

import pytest
from compare import assert_same

from tempora.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, sf, duck, name):
    assert_same(catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.SQL[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
