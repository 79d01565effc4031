"""Every registered query against its SQL in DuckDB."""

import math
import os

import duckdb
import pandas as pd
import pytest

from gritstone import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def cell(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 4)
    return x.item() if hasattr(x, "item") else x


def rows_of(rows, cols):
    return sorted((tuple(cell(r[c]) for c in cols) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, sf, duck, name):
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    want = rows_of([dict(zip(names, r)) for r in cur.fetchall()], sorted(names))
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    have = rows_of([r.asDict() for r in got.collect()], sorted(names))
    assert len(have) == len(want)
    for a, b in zip(have, want):
        assert a == pytest.approx(b) if all(isinstance(x, (int, float)) for x in a) else a == b


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
