"""Every query of the engine against its SQL, at the smallest size."""

import datetime
import os

import duckdb
import pytest

from graniq.queries import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def norm(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cur = duck.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    want = sorted([norm(v) for _, v in sorted(zip(columns, r))] for r in cur.fetchall())
    got = sorted([norm(v) for _, v in sorted(r.asDict(True).items())] for r in df.collect())
    assert sorted(columns) == sorted(df.columns)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
