"""Every training-data query with an oracle against DuckDB on the smallest tables; the others run there."""

import glob
import os

import duckdb
import pytest
from test_oracles import DATA, ordered, plain

from textloom.llm.queries import ORACLES, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert ordered([tuple(plain(row[c]) for c in columns) for row in rows]) == ordered([tuple(plain(v) for v in row) for row in cursor.fetchall()])
