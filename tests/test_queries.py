"""Every registered query of the library runs at the smallest scale and equals its SQL."""

import math
import os

import duckdb
import pytest

from marginalia.oracles import ORACLES
from marginalia.queries import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")
TABLES = ("documents", "pages", "benchmark", "part", "lineitem")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, db, name):
    df = queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    assert got
    if name in ORACLES:
        found = db.execute(f"SELECT * FROM ({ORACLES[name]})")
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=key)
        assert got == want
