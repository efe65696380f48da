"""Every report against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from rankloom.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "tolist"):
        return plain(v.tolist())
    return [plain(x) for x in v] if isinstance(v, list) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_report(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    got_rows = [[plain(r[c]) for c in columns] for r in df.collect()]
    order = [want.columns.index(c) for c in columns]
    want_rows = [[plain(r[i]) for i in order] for r in want.fetchall()]
    assert sorted(map(str, got_rows)) == sorted(map(str, want_rows))
