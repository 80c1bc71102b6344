import pytest
from tests.oracle import SMALL, rows_of, sql_rows

from leafwork.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_rows_are_those_of_sql(spark, name):
    assert rows_of(catalog.QUERIES[name](spark, SMALL)) == sql_rows(catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_rows_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_entry_lists_all_and_imports_without_optional_parts():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
