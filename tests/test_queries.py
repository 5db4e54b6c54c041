"""Every registered query against its SQL on the same tables."""

import pytest

from checks.compare import difference
from checks.registry import oracle_sql, queries

QUERIES, SQL = queries(), oracle_sql()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, spark, sf_dir, duck):
    assert difference(QUERIES[name](spark, sf_dir), duck, SQL[name]) is None
