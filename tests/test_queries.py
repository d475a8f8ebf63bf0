"""Every registered query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from strandline.plans import registry

SF = "/root/testdata/sf0.001"
SLOW = {q for q in registry.ORACLE_SQL if q.startswith("vecdist_")} - {"vecdist_bray_curtis", "vecdist_binary_lennon"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def text(x) -> str:
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float | np.floating) and np.isnan(x)):
        return "-"
    if isinstance(x, list | np.ndarray):
        return "[" + ",".join(map(text, x)) + "]"
    if isinstance(x, bool | np.bool_):
        return str(bool(x))
    return f"{float(x):.6g}" if isinstance(x, int | float | np.number) and abs(x) < 1e15 else str(x)


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    return sorted("|".join(map(text, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(q for q in registry.ORACLE_SQL if q not in SLOW))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
