import pytest

from earshot.llm.registry import ORACLES, QUERIES
from tests.oracle import duckdb_rows, rows_of

from .fixtures import SF


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("sf_dir", [SF, "/root/testdata/sf0.01"])
def test_query_equals_its_sql(spark, name, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    columns, expected = duckdb_rows(ORACLES[name], sf_dir)
    assert sorted(df.columns) == columns and got == expected


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
