"""Every query with SQL against DuckDB on the smallest tables; every other one has to run."""

from __future__ import annotations

import os
from decimal import Decimal

import duckdb
import pytest

from tessella import queries as Q

Q.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, (float, Decimal)):
        return round(float(value), 6) + 0.0
    return str(value)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(name, spark, sf, duck):
    df = Q.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    assert len({c.lower() for c in columns}) == len(columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name not in Q.SQL:
        return
    result = duck.execute(Q.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert rows == sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in result.fetchall())
