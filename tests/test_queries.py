"""Every registered query of the point engine equals its SQL."""

import pytest

from mortonlake import queries

from .conftest import DATA


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(same, name):
    same(queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())
