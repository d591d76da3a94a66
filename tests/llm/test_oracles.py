"""Queries of this subpackage that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from cadenza.llm import registry
from tests.test_oracle import DATA, TABLES, rows


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.QUERIES[name](spark, DATA)
    want = con.execute(registry.ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
