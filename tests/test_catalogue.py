"""Every registered query against DuckDB on the smallest tables."""

import datetime
import math
from decimal import Decimal

import duckdb
import pytest

from skarn.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    got = duck.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in got.description]
    want = got.fetchall()
    cols = sorted(names)
    assert sorted(df.columns) == cols
    at = [names.index(c) for c in cols]
    left = sorted((tuple(plain(r[c]) for c in cols) for r in rows), key=repr)
    right = sorted((tuple(plain(r[i]) for i in at) for r in want), key=repr)
    assert left == right
