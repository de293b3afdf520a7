"""Volumes of 0 give the NaN quotients that the SQL gives, told apart from null, and no error."""

import duckdb
import pandas as pd
import pytest

from ticklane.plans import catalogue

#: Per symbol the numbers in props, sizes less 1; a bar has two trades.
SIZES = {1: [-1] * 16, 2: [-1] * 10 + [4, -1, 7, 0, 2, 2], 3: [3, 0, -1, -1, -1, -1, -1, -1, -1, -1, -1, -1, -1, -1, 5, 1], 4: [1, 2]}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    start = pd.Timestamp("2024-01-01 06:00")
    made = [(s, start + pd.Timedelta(hours=12 * i, minutes=s), "click", 2.0 + i * s % 5, f'{{"k": {k}}}') for s, sizes in SIZES.items() for i, k in enumerate(sizes)]
    frame = pd.DataFrame(made, columns=["user_id", "ts", "event_type", "value", "props"])
    frame["ts"] = frame["ts"].astype("datetime64[us]")
    frame["event_id"] = range(len(frame))
    path = tmp_path_factory.mktemp("zero")
    frame.to_parquet(f"{path}/events.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["bar_rolling", "relative_volume", "bar_features", "resample_ohlc"])
def test_query_equals_sql_at_zero_volumes(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{folder}/events.parquet')")
    got = catalogue.QUERIES[name](spark, folder)
    columns = sorted(got.columns)
    expected = con.execute(f"select {', '.join(columns)} from ({catalogue.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, expected))
    assert "nan" in repr(expected)
