"""Registered queries against their SQL, on the smallest tables."""

import pytest
from duck import duck_rows, rows_of

from fathom.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert rows_of(queries.queries()[name](spark, sf_dir)) == duck_rows(SQL[name], sf_dir)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
