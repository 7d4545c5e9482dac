"""Every query with SQL gives the same rows as an independent engine."""

import glob
import math
import os

import duckdb
import pytest

from framelake.queries import ORACLES, QUERIES


def plain(v):
    if hasattr(v, "asDict"):
        v = tuple(v)
    if isinstance(v, dict):
        return sorted((k, plain(x)) for k, x in v.items())
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = [plain(tuple(r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = [[plain(r[i]) for i in at] for r in found.fetchall()]
    assert sorted(map(str, got)) == sorted(map(str, want))
