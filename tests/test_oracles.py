"""Every registered query with SQL against DuckDB on the smallest tables; those without give rows."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from vellumframe import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool | np.bool_):
        return bool(v)
    if isinstance(v, float | np.floating):
        return round(float(v), 9)
    return int(v) if isinstance(v, int | np.integer) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    assert got
    if name in plans.ORACLE_SQL:
        r = duck.execute(plans.ORACLE_SQL[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == columns
        want = sorted((tuple(plain(x[names.index(c)]) for c in columns) for x in r.fetchall()), key=key)
        assert got == want
