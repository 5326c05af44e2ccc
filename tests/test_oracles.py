"""Every engine query with an oracle against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from readweave.plans import queries as Q


def rows(frame):
    cols = sorted(frame.columns)
    return sorted(tuple(str(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in frame[cols].astype(object).where(frame[cols].notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_oracle(spark, tiny, name):
    con = duckdb.connect()
    for path in glob.glob(f"{tiny}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    want = con.sql(Q.SQL[name]).df()
    got = Q.QUERIES[name](spark, tiny).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_rows_only(spark, tiny):
    for name in set(Q.QUERIES) - set(Q.SQL):
        assert Q.QUERIES[name](spark, tiny).count() > 0
