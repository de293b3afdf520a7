"""Backtests as scans: the equity curve is a running product over the trades, its drawdowns follow from the running maximum. A symbol is spread over time buckets of `width` seconds."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import divide
from .keys import KEYS, Keys
from .scan import DAY, Running, with_running


def trades_of(predictions: DataFrame, threshold: float = 0.0, sizing: str = "fixed", cost: float = 0.0005, capital: float = 100_000.0, keys: Keys = KEYS, width: float = DAY) -> DataFrame:
    """Predictions (label, prediction, probability, return, regime) that trade, with confidence, size, signal, net return, pnl and capital after each.

    sizing: fixed 1; regime: half in Volatile regimes; confidence: the confidence itself.
    """
    confidence = 2 * F.abs(F.col("probability") - 0.5)
    sizes = {"fixed": F.lit(1.0), "regime": F.when(F.col("regime") == "Volatile", 0.5).otherwise(1.0), "confidence": F.col("confidence")}
    signal = F.when(F.col("prediction") == 1, 1).otherwise(-1)
    rows = predictions.withColumn("confidence", confidence).where(F.col("confidence") >= threshold)
    return _curve(rows.withColumns({"size": sizes[sizing], "signal": signal}), cost, capital, keys, width)


def _curve(rows: DataFrame, cost: float, capital: float, keys: Keys, width: float) -> DataFrame:
    """Rows with signal and size, with net return, capital after each trade, pnl and whether the prediction was right."""
    rows = rows.withColumn("net_return", F.col("signal") * F.col("return") - cost)
    growth = 1 + F.col("size") * F.col("net_return")
    curve = with_running(rows, {"_after": Running("product", growth), "_before": Running("product", growth, earlier=True)}, width, keys)
    after, before = capital * F.col("_after"), capital * F.coalesce("_before", F.lit(1.0))
    return curve.withColumns({"capital": after, "pnl": after - before, "correct": F.col("prediction") == F.col("label")}).drop("_after", "_before")


def sharpe(returns: Column | str, per_year: int = 252, risk_free: float = 0.0) -> Column:
    """Aggregate: (mean - rate per period) by population deviation, annualised; 0 without deviation."""
    return F.coalesce(divide(F.avg(returns) - risk_free / per_year, F.stddev_pop(returns)), F.lit(0.0)) * math.sqrt(per_year)


def sortino(returns: Column | str, per_year: int = 252, risk_free: float = 0.0) -> Column:
    """As sharpe, with the population deviation of negative returns."""
    r = F.col(returns) if isinstance(returns, str) else returns
    return F.coalesce(divide(F.avg(r) - risk_free / per_year, F.stddev_pop(F.when(r < 0, r))), F.lit(0.0)) * math.sqrt(per_year)


def performance(trades: DataFrame, capital: float = 100_000.0, keys: Keys = KEYS, width: float = DAY) -> DataFrame:
    """Per symbol: trades, total return, Sharpe and Sortino ratio, largest drawdown, Calmar ratio, hit rate, profit factor (gains by losses, infinite without losses), mean gain, mean loss and the size of their ratio (0 without losses)."""
    curve = with_running(trades, {"_top": Running("max", "capital")}, width, keys).withColumn("_top", F.greatest("_top", F.lit(capital)))
    curve = curve.withColumn("_down", divide(F.col("capital") - F.col("_top"), F.col("_top")))
    order, pnl = F.struct(keys.ts, keys.seq), F.col("pnl")
    won, lost = F.when(pnl > 0, pnl), F.when(pnl < 0, pnl)
    out = curve.groupBy(keys.symbol).agg(
        F.count("*").alias("n_trades"), (F.max_by("capital", order) / capital - 1).alias("total_return"), sharpe("net_return").alias("sharpe"), sortino("net_return").alias("sortino"),
        F.abs(F.min("_down")).alias("max_drawdown"), F.avg(F.col("correct").cast("double")).alias("win_rate"),
        F.coalesce(divide(F.coalesce(F.sum(won), F.lit(0.0)), F.abs(F.sum(lost))), F.lit(math.inf)).alias("profit_factor"), F.coalesce(F.avg(won), F.lit(0.0)).alias("average_win"), F.coalesce(F.avg(lost), F.lit(0.0)).alias("average_loss"),
    )
    ratio = F.coalesce(F.abs(divide(F.col("average_win"), F.col("average_loss"))), F.lit(0.0))
    return out.withColumns({"win_loss_ratio": ratio, "calmar": F.coalesce(divide(F.col("total_return"), F.col("max_drawdown")), F.lit(0.0))})


def drawdown_episodes(curve: DataFrame, value: str = "capital", least_percent: float = 1.0, keys: Keys = KEYS, width: float = DAY) -> DataFrame:
    """(symbol, start, end, depth, rows, peak, recovery, recovery_rows): runs of rows more than least_percent below the running maximum.

    recovery is the time of the first later row at or above that maximum, null where none comes; recovery_rows counts the rows from the episode's start to it. Such a row
    is a new maximum, so it is met by a scan from the series' end; no row is compared with later ones.
    """
    place = F.struct(keys.ts, keys.seq)
    tops = with_running(curve, {"_before": Running("max", value, earlier=True), "_n": Running("count")}, width, keys).withColumn("_top", F.greatest("_before", value))
    down = tops.withColumn("_down", divide(F.col(value) - F.col("_top"), F.col("_top"))).withColumns({"_in": F.coalesce(F.col("_down") * 100 <= -least_percent, F.lit(False)), "_high": F.coalesce(F.col(value) >= F.col("_before"), F.lit(False))})
    placed = with_running(down, {"_out": Running("last", F.when(~F.col("_in"), place))}, width, keys)
    ahead = with_running(placed, {"_next": Running("last", F.when(F.col("_high"), F.struct(F.col(keys.ts).alias("ts"), "_n")), earlier=True)}, width, keys, reverse=True)
    each = ahead.where("_in").groupBy(keys.symbol, "_out").agg(F.min(keys.ts).alias("start"), F.max(keys.ts).alias("end"), F.abs(F.min("_down")).alias("depth"), F.count("*").alias("rows"), F.max("_top").alias("peak"), F.min("_next").alias("_next"), F.min("_n").alias("_n"))
    return each.withColumns({"recovery": F.col("_next.ts"), "recovery_rows": F.col("_next._n") - F.col("_n")}).drop("_out", "_next", "_n")


def by_regime(trades: DataFrame) -> DataFrame:
    return trades.groupBy("regime").agg(F.count("*").alias("n"), F.avg("pnl").alias("pnl_mean"), F.sum("pnl").alias("pnl_sum"), F.stddev_samp("pnl").alias("pnl_std"), F.avg(F.col("correct").cast("double")).alias("hit_rate"), F.avg("confidence").alias("confidence"), F.avg("size").alias("size"))


def compared_strategies(strategies: dict[str, DataFrame], by: str = "sharpe", capital: float = 100_000.0, keys: Keys = KEYS) -> DataFrame:
    """performance of each strategy's trades, with its name, best first by a measure."""
    out = None
    for name, trades in strategies.items():
        one = performance(trades, capital, keys).withColumn("strategy", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc(by), "strategy", keys.symbol)


def five_strategies(predictions: DataFrame, threshold: float = 0.5, strict: float = 0.6, regime_prediction: str = "regime_prediction", regime_probability: str = "regime_probability", cost: float = 0.0005, capital: float = 100_000.0, keys: Keys = KEYS, width: float = DAY) -> DataFrame:
    """Trades of five strategies over predictions of one model and of regime models (two further columns), with strategy:

    baseline trades the model at a fixed size, regime_model the regimes' models; regime_sizing halves the size in Volatile regimes; confidence trades only
    beyond the strict threshold; combined takes the regimes' models, their sizes and the strict threshold. Rows are read once, each taken as often as
    there are strategies.
    """
    half = F.when(F.col("regime") == "Volatile", 0.5).otherwise(1.0)
    one = lambda name, p, q, size, least: F.struct(F.lit(name).alias("strategy"), F.col(p).alias("prediction"), F.col(q).cast("double").alias("probability"), size.alias("size"), F.lit(least).alias("_least"))
    whole, by = ("prediction", "probability"), (regime_prediction, regime_probability)
    each = [one("baseline", *whole, F.lit(1.0), threshold), one("regime_model", *by, F.lit(1.0), threshold), one("regime_sizing", *whole, half, threshold), one("confidence", *whole, F.lit(1.0), strict), one("combined", *by, half, strict)]
    rows = predictions.withColumn("_s", F.explode(F.array(*each))).drop(*whole, *by).select("*", "_s.*").drop("_s")
    rows = rows.withColumn("confidence", 2 * F.abs(F.col("probability") - 0.5)).where(F.col("confidence") >= F.col("_least")).drop("_least")
    rows = rows.withColumns({"signal": F.when(F.col("prediction") == 1, 1).otherwise(-1), "_series": F.struct("strategy", keys.symbol)})
    return _curve(rows, cost, capital, replace(keys, symbol="_series"), width).drop("_series")


def strategy_performance(trades: DataFrame, capital: float = 100_000.0, keys: Keys = KEYS, width: float = DAY) -> DataFrame:
    """performance by strategy and symbol of trades with a strategy, all from one scan."""
    found = performance(trades.withColumn("_series", F.struct("strategy", keys.symbol)), capital, replace(keys, symbol="_series"), width)
    return found.select("_series.*", *[c for c in found.columns if c != "_series"])
