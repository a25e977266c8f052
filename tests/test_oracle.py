"""Every query with SQL beside it gives the same rows as DuckDB; the others run."""

import pytest
from compare import rows_of, rows_of_sql

from ledgerlake.plans.registry import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    assert rows_of(QUERIES[name](spark, sf_dir)) == rows_of_sql(duck, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
