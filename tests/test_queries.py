import pytest

from earshot import catalogue, reference_queries  # noqa: F401

from .oracle import duckdb_rows, rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    columns, expected = duckdb_rows(catalogue.ORACLES[name], SF)
    assert sorted(df.columns) == columns
    assert len(got) == len(expected)
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
