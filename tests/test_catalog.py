import pytest
from compare import rows_of, rows_of_sql

from scorewright import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, duck, sf_dir, name):
    assert rows_of(catalog.QUERIES[name](spark, sf_dir)) == rows_of_sql(duck, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_returns_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0
