"""Every core query with an oracle against DuckDB on the smallest tables."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

from textloom.plans import registry

DATA = "/root/testdata/sf0.001"
ORACLES = registry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (float, Decimal)):
        return None if math.isnan(v) else 0.0 if v == 0 else float(f"{float(v):.9g}")
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = [tuple(plain(v) for v in row) for row in cursor.fetchall()]
    got = [tuple(plain(row[c]) for c in columns) for row in df.collect()]
    number = lambda rows: [tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r) for r in rows]
    assert ordered(number(got)) == ordered(number(want))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLES)))
def test_query_without_oracle_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0
