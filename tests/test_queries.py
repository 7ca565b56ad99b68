"""Every registered query with SQL gives the rows that DuckDB gives on the same tables."""

import glob
import os

import duckdb
import pytest

from meshwright.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{small}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    assert glob.glob(f"{small}/*.parquet")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(columns), sorted([tuple(clean(r[i]) for i in order) for r in rows])


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, duck, small, name):
    df = catalog.queries()[name](spark, small)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(catalog.oracle_sql()[name])
    want = _rows([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_run(spark, small, name):
    df = catalog.queries()[name](spark, small)
    assert df.columns and df.collect()
