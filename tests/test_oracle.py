"""Each registered query against its DuckDB SQL on the smallest tables."""

import duckdb
import pytest

from cadenza.plans.catalogue import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def cell(x):
    if x is None or x != x:
        return ""
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return f"{x:.9g}"
    return str(int(x)) if hasattr(x, "__int__") and not isinstance(x, str) else str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLE:
        want = duck.execute(ORACLE[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows(df.columns, got) == rows(columns, want.fetchall())
