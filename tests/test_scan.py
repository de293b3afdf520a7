import math
import random

import pytest
from pyspark.sql import functions as F

from ticklane.operators import backtest, rolling
from ticklane.operators.scan import Running, with_running

SCHEMA = "symbol string, ts timestamp, seq long, x double"


def series(spark, n=400, seed=1):
    r = random.Random(seed)
    rows, t = [], 1_700_000_000
    for i in range(n):
        t += r.choice([0, 1, 30, 4000])
        rows.append((r.choice(["a", "a", "a", "b", None]), t, i, r.choice([None, r.uniform(-1, 1)])))
    return rows, spark.createDataFrame(rows, "symbol string, t long, seq long, x double").selectExpr("symbol", "timestamp_seconds(t) as ts", "seq", "x")


def brute(rows, reverse=False):
    out = {}
    for s in {r[0] for r in rows}:
        seen, n, last = [], 0, None
        own = sorted((r for r in rows if r[0] == s), key=lambda r: (r[1], r[2]), reverse=reverse)
        for r in own:
            before = (sum(seen) if seen else None, max(seen, default=None), last, n or None)
            n += 1
            if r[3] is not None:
                seen.append(r[3])
                last = r[3]
            out[r[2]] = (sum(seen) if seen else None, math.prod(1 + v for v in seen) if seen else None, max(seen, default=None), min(seen, default=None), last, n, *before)
    return out


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("width", [1.0, 600.0, 1e9])
def test_running_aggregates_do_not_depend_on_buckets(spark, width, reverse):
    rows, df = series(spark)
    x = F.col("x")
    columns = {"sum": Running("sum", x), "product": Running("product", 1 + x), "max": Running("max", "x"), "min": Running("min", "x"), "last": Running("last", "x"), "n": Running("count")}
    columns |= {"sum_before": Running("sum", x, earlier=True), "max_before": Running("max", x, earlier=True), "last_before": Running("last", x, earlier=True), "n_before": Running("count", earlier=True)}
    got = {r.seq: tuple(r[c] for c in columns) for r in with_running(df, columns, width, reverse=reverse).collect()}
    expected = brute(rows, reverse)
    assert got.keys() == expected.keys()
    for k, v in expected.items():
        assert all((a is None and b is None) or a == pytest.approx(b) for a, b in zip(got[k], v)), (k, got[k], v)


def test_no_window_sorts_a_whole_symbol(spark):
    _, df = series(spark)
    for made in (rolling.with_vwap(df.withColumn("v", F.lit(1.0)), "x", "v"), with_running(df, {"n": Running("count")})):
        plan = made._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        lines = [line for line in plan.splitlines() if "Window [" in line]
        assert lines and all("_bucket" in line for line in lines)


def test_running_vwap_equals_the_window(spark):
    _, df = series(spark)
    df = df.withColumn("v", F.when(F.col("seq") % 7 != 0, F.col("seq") % 5 + 1.0))
    expected = {r.seq: r.w for r in df.withColumn("w", rolling.vwap("x", "v")).collect()}
    for width in (10.0, 5000.0):
        got = {r.seq: r.w for r in rolling.with_vwap(df, "x", "v", "w", width).collect()}
        assert got.keys() == expected.keys() and all((got[k] is None) == (v is None) and (v is None or got[k] == pytest.approx(v)) for k, v in expected.items())


def test_drawdowns_recover_at_the_first_row_at_or_above_the_peak(spark):
    values = [100, 90, 80, 99.5, 95, 100, 120, 110, 119.9, 60, 119, 121, 100]
    df = spark.createDataFrame([("a", 1_700_000_000 + 50 * i, i, float(v)) for i, v in enumerate(values)], "symbol string, t long, seq long, capital double").selectExpr("symbol", "timestamp_seconds(t) as ts", "seq", "capital")
    at = lambda t: None if t is None else (int(t.timestamp()) - 1_700_000_000) // 50
    for width in (1.0, 120.0, 1e8):
        rows = sorted((at(r.start), at(r.end), r.rows, r.peak, at(r.recovery), r.recovery_rows) for r in backtest.drawdown_episodes(df, width=width).collect())
        assert rows == [(1, 2, 2, 100.0, 5, 4), (4, 4, 1, 100.0, 5, 1), (7, 7, 1, 120.0, 11, 4), (9, 9, 1, 120.0, 11, 2), (12, 12, 1, 121.0, None, None)]


def test_gains_and_losses(spark):
    rows = [("a", 1_700_000_000 + i, i, pnl, 100.0, pnl / 100, 1, 1) for i, pnl in enumerate([4.0, -1.0, 0.0, 2.0, -2.0])] + [("b", 1_700_000_000, 9, 1.0, 101.0, 0.01, 1, 0)]
    df = spark.createDataFrame(rows, "symbol string, t long, seq long, pnl double, capital double, net_return double, label int, prediction int").selectExpr("*", "timestamp_seconds(t) as ts", "label = prediction as correct")
    got = {r.symbol: (r.profit_factor, r.average_win, r.average_loss, r.win_loss_ratio) for r in backtest.performance(df, 100.0).collect()}
    assert got == {"a": (2.0, 3.0, -1.5, 2.0), "b": (math.inf, 1.0, 0.0, 0.0)}
