"""Every query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from quarry.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*')" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rel = duck.execute(SQL[name])
    names = [x[0] for x in rel.description]
    want = [dict(zip(names, r, strict=True)) for r in rel.fetchall()]
    assert sorted(names) == cols
    key = lambda r: tuple((x is None, str(type(x)), x) if x is not None else (True, "", 0) for x in r)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    assert got == sorted((tuple(plain(r[c]) for c in cols) for r in want), key=key)
    assert want
