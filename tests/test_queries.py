"""Every query with SQL gives the SQL's rows on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from ticklane.plans import catalogue

SMALL = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if hasattr(v, "item") and getattr(v, "ndim", 1) == 0:
        v = v.item()
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    return str(v) if isinstance(v, pd.Timestamp) else v


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted([tuple(map(plain, r)) for r in df[columns].itertuples(index=False)], key=repr)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, sql, name):
    assert rows(catalogue.QUERIES[name](spark, SMALL).toPandas()) == rows(sql.execute(catalogue.ORACLE_SQL[name]).df())


def test_flagship_is_registered():
    assert catalogue.FLAGSHIP in catalogue.QUERIES
