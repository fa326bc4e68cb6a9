"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from loomveil.plans import registry

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = entry.queries()[name](spark, SF)
    want = con.sql(registry.ORACLE[name])
    names, order = want.columns, sorted(df.columns)
    assert sorted(names) == order
    got = sorted(repr([norm(r[c]) for c in order]) for r in df.collect())
    assert got == sorted(repr([norm(dict(zip(names, r))[c]) for c in order]) for r in want.fetchall())
