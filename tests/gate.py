"""Compares queries with their SQL in DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

FOLDER = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")


def connection():
    con = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def _text(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.6g}" if abs(v) < 1e6 else str(int(v)) if float(v).is_integer() else f"{v:.6g}"
    return str(v)


def canon(df):
    return sorted("|".join(_text(x.item() if hasattr(x, "item") else x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


def compare(spark, query, sql):
    a, b = query(spark, FOLDER).toPandas(), connection().sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert canon(a) == canon(b)
