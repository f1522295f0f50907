"""Every query against its SQL on the smallest input, and the contract of the entry module."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import ORACLES, QUERIES

DATA = os.environ.get("TESSERA_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=repr)
    if name in ORACLES:
        got = duck.execute(ORACLES[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == columns
        assert rows == sorted([tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in got.fetchall()], key=repr)
    else:
        assert rows


def test_entry(spark):
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() == 8
