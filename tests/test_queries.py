"""Every registered query of the library against its SQL on the smallest tables."""

import datetime
import decimal
import os
from pathlib import Path

import duckdb
import pytest

from marlstone import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    want = db.sql(catalog.ORACLE_SQL[name])
    cols = sorted(c[0] for c in want.description)
    assert sorted(df.columns) == cols
    at = [[c[0] for c in want.description].index(c) for c in cols]
    assert sorted((tuple(plain(r[c]) for c in cols) for r in rows), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_plans(spark):
    """Top-k is limited before the shuffle, versions need one exchange of the log, scans read only their columns."""
    plan = lambda n: catalog.QUERIES[n](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan("r2_dense_topk")
    assert plan("v2_version_history").count("Exchange hashpartitioning") == 1
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan("p2_canonical_urls")
