"""Prices of 0 give the infinite quotients that the SQL gives, and no error."""

import duckdb
import pandas as pd
import pytest

from ticklane.plans import catalogue

from .test_queries import rows

TRADES = {6: [3.0, 4.0, 5.0, 4.0, 3.0, 5.0, 6.0, 7.0, 6.0, 5.0, 4.0, 6.0, 5.0, 7.0], 7: [0.0, 5.0, 4.0, 6.0, 5.5, 6.5, 7.0, 0.0, 0.0, 3.0, 2.0, 4.0, 5.0, 6.0], 8: [3.0, 4.0, 0.0, 2.0, 5.0, 5.0], 9: [0.0, 0.0, 1.0]}
QUOTES = {6: [4.0, 5.0], 7: [5.0, 0.0, 4.0], 8: [0.0, 3.0], 9: [0.0]}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    made, start = [], pd.Timestamp("2024-01-01 10:00")
    for symbol in TRADES:
        made += [(symbol, start + pd.Timedelta(hours=5 * i, minutes=symbol), "purchase", v) for i, v in enumerate(TRADES[symbol])]
        made += [(symbol, start + pd.Timedelta(hours=9 * i - 1, minutes=symbol), "view", v) for i, v in enumerate(QUOTES[symbol])]
    frame = pd.DataFrame(made, columns=["user_id", "ts", "event_type", "value"])
    frame["ts"] = frame["ts"].astype("datetime64[us]")
    frame["event_id"] = range(len(frame))
    frame["props"] = [f'{{"k": {i * 7 % 100}}}' for i in range(len(frame))]
    path = tmp_path_factory.mktemp("zero")
    frame.to_parquet(f"{path}/events.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["bar_features", "bar_rolling", "trade_impact", "log_returns", "rolling_volatility"])
def test_query_equals_sql_at_zero_prices(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{folder}/events.parquet')")
    assert rows(catalogue.QUERIES[name](spark, folder).toPandas()) == rows(con.execute(catalogue.ORACLE_SQL[name]).df())


def test_bars_without_a_range_are_left_out_of_hidden_regimes(spark, folder):
    got = catalogue.QUERIES["hidden_regimes"](spark, folder).collect()
    assert {r.symbol for r in got} == {6} and all(r.regime for r in got)
