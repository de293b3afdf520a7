"""Row-framed rolling and sequential operators over (symbol, ts, seq).

Expressions that share a window are planned with one sort; add them in one withColumns. A frame shorter than asked gives
null unless stated otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import book
from ..functions.scalar import EPSILON, col, correlation, divide, log_ratio, quotient, seconds_between, unbiased_kurtosis, unbiased_skew
from .keys import KEYS, Keys
from .scan import DAY, Running, with_running, with_totals

MINUTES_PER_YEAR = 252 * 390


def full(value: Column, x: Column | str, k: int, keys: Keys = KEYS, least: int | None = None) -> Column:
    """value where the last k rows hold at least `least` (default k) values of x."""
    return F.when(F.count(col(x)).over(keys.last(k)) >= (k if least is None else least), value)


def log_return(price: Column | str, lag: int = 1, keys: Keys = KEYS) -> Column:
    return log_ratio(col(price), F.lag(col(price), lag).over(keys.ordered()))


def simple_return(price: Column | str, lag: int = 1, keys: Keys = KEYS) -> Column:
    return quotient(col(price), F.lag(col(price), lag).over(keys.ordered())) - 1


def change(x: Column | str, lag: int = 1, keys: Keys = KEYS) -> Column:
    return col(x) - F.lag(col(x), lag).over(keys.ordered())


def rolling_mean(x: Column | str, k: int, keys: Keys = KEYS, least: int | None = None) -> Column:
    return full(F.avg(col(x)).over(keys.last(k)), x, k, keys, least)


def rolling_std(x: Column | str, k: int, keys: Keys = KEYS, least: int | None = None) -> Column:
    """Sample deviation; null for fewer than two values."""
    return full(F.stddev_samp(col(x)).over(keys.last(k)), x, k, keys, least)


def volatility(returns: Column | str, k: int, annualise: bool = False, keys: Keys = KEYS) -> Column:
    return rolling_std(returns, k, keys) * (math.sqrt(MINUTES_PER_YEAR) if annualise else 1.0)


def realised_volatility(returns: Column | str, k: int, annualise: bool = False, keys: Keys = KEYS) -> Column:
    """Root of the sum of squared returns."""
    r = col(returns)
    return full(F.sqrt(F.sum(r * r).over(keys.last(k))), r, k, keys) * (math.sqrt(MINUTES_PER_YEAR / k) if annualise else 1.0)


def vwap(price: Column | str, volume: Column | str, k: int | None = None, daily: bool = False, keys: Keys = KEYS) -> Column:
    """Volume-weighted price: running, running within each date, or of the last k rows that have both; null on rows without price or volume."""
    p, v = col(price), col(volume)
    both = p.isNotNull() & v.isNotNull()
    if daily:
        frame = Window.partitionBy(keys.symbol, F.to_date(keys.ts)).orderBy(keys.ts, keys.seq).rowsBetween(Window.unboundedPreceding, 0)
    elif k:
        frame = Window.partitionBy(keys.symbol, both).orderBy(keys.ts, keys.seq).rowsBetween(-(k - 1), 0)
    else:
        frame = keys.so_far()
    return F.when(both, F.sum(F.when(both, p * v)).over(frame) / (F.sum(F.when(both, v)).over(frame) + EPSILON))


def with_vwap(df: DataFrame, price: str, volume: str, name: str = "vwap", width: float = DAY, keys: Keys = KEYS) -> DataFrame:
    """df with the running volume-weighted price of the symbol so far, as vwap gives it, by a scan over time buckets of `width` seconds."""
    p, v = F.col(price), F.col(volume)
    both = p.isNotNull() & v.isNotNull()
    sums = with_running(df, {"_pv": Running("sum", F.when(both, p * v)), "_v": Running("sum", F.when(both, v))}, width, keys)
    return sums.withColumn(name, F.when(both, F.col("_pv") / (F.col("_v") + EPSILON))).drop("_pv", "_v")


def inter_arrival(keys: Keys = KEYS, unit: float = 1.0) -> Column:
    """Seconds since the row before, times unit."""
    return seconds_between(F.lag(keys.ts).over(keys.ordered()), keys.ts) * unit


def time_since(event: Column, keys: Keys = KEYS) -> Column:
    """Seconds since the last strictly earlier row with event; event may hold windows of its own."""
    return seconds_between(F.last(F.when(event, F.col(keys.ts)), ignorenulls=True).over(keys.earlier()), keys.ts)


def with_time_since(df: DataFrame, event: Column, name: str, keys: Keys = KEYS) -> DataFrame:
    """df with the seconds since the last earlier row with event, which may be a window expression."""
    return df.withColumn("_event", event).withColumn(name, time_since(F.col("_event"), keys)).drop("_event")


def price_changed(price: Column | str, threshold: float = 0.0, keys: Keys = KEYS) -> Column:
    return F.coalesce(F.abs(change(price, 1, keys)) > threshold, F.lit(False))


def volume_spiked(volume: Column | str, times: float = 2.0, k: int = 20, keys: Keys = KEYS) -> Column:
    """Volume above a multiple of the mean of the last k rows, the current one included."""
    return F.coalesce(col(volume) > times * F.avg(col(volume)).over(keys.last(k)), F.lit(False))


def arrival_rate(gap: Column | str, k: int = 20, per: float = 1.0, keys: Keys = KEYS) -> Column:
    """(k - 1) by the sum of the last k gaps, in events per `per` seconds; null before the first gap."""
    return full((k - 1) * per / (F.sum(col(gap)).over(keys.last(k)) + EPSILON), gap, k, keys, least=1)


def variation(x: Column | str, k: int, least: int, keys: Keys = KEYS) -> Column:
    """Deviation by mean of the last k rows."""
    return full(divide(F.stddev_samp(col(x)).over(keys.last(k)), F.avg(col(x)).over(keys.last(k))), x, k, keys, least)


def impact(mid: Column | str, horizon: int, side: Column | str | None = None, keys: Keys = KEYS) -> Column:
    """Change of the mid price over the next `horizon` rows, signed by side."""
    move = F.lead(col(mid), horizon).over(keys.ordered()) - col(mid)
    return move if side is None else move * col(side)


def ewma_std(x: str, span: int, keys: Keys = KEYS) -> Column:
    """Bias-corrected deviation with weights (1 - 2/(span+1))^age; the frame reaches back until weights fall below 1e-15. Null for fewer than two values."""
    keep = 1 - 2 / (span + 1)
    depth = math.ceil(math.log(1e-15) / math.log(keep))
    rows = F.collect_list(F.struct(F.coalesce(F.col(x), F.lit(float("nan"))).alias("v"))).over(keys.last(depth))
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("w", "wx", "wxx", "ww")])

    def step(a: Column, r: Column) -> Column:
        here = ~F.isnan(r["v"])
        v, w = F.when(here, r["v"]).otherwise(0.0), F.when(here, 1.0).otherwise(0.0)
        return F.struct((a["w"] * keep + w).alias("w"), (a["wx"] * keep + w * v).alias("wx"), (a["wxx"] * keep + w * v * v).alias("wxx"), (a["ww"] * keep * keep + w).alias("ww"))

    def finish(a: Column) -> Column:
        mean = divide(a["wx"], a["w"])
        spread = F.greatest(divide(a["wxx"], a["w"]) - mean * mean, F.lit(0.0))
        return F.sqrt(divide(spread * a["w"] * a["w"], a["w"] * a["w"] - a["ww"]))

    return F.when(F.count(F.col(x)).over(keys.last(depth)) >= 2, F.aggregate(rows, zero, step, finish))


def rolling_skew(x: str, k: int, keys: Keys = KEYS) -> Column:
    frame = keys.last(k)
    return full(unbiased_skew(F.count(x).over(frame), F.skewness(x).over(frame)), x, k, keys)


def rolling_kurtosis(x: str, k: int, keys: Keys = KEYS) -> Column:
    frame = keys.last(k)
    return full(unbiased_kurtosis(F.count(x).over(frame), F.kurtosis(x).over(frame)), x, k, keys)


def with_bar_dynamics(bars: DataFrame, price: str = "close", volume: str = "volume", k: int = 30, lags: tuple[int, ...] = (1, 5, 10), signature: tuple[int, ...] = (1, 5, 10, 15, 30), keys: Keys = KEYS) -> DataFrame:
    """Bars with returns, Roll spread, variance ratio, volatility signature, EWMA volatilities, moments and autocorrelations, all over one sort."""
    r = F.col("ret")
    frame = lambda a, b=0: keys.ordered().rowsBetween(a, b)
    out = bars.withColumns({"ret": simple_return(price, 1, keys), "_vol": F.col(volume).cast("double")})
    out = out.withColumns({"_prev": F.lag("ret").over(keys.ordered()), "_sum5": full(F.sum("ret").over(keys.last(5)), "ret", 5, keys), **{f"_r{n}": F.lag("ret", n).over(keys.ordered()) for n in lags}, **{f"_v{n}": F.lag("_vol", n).over(keys.ordered()) for n in lags}})
    covariance = F.covar_samp("ret", "_prev").over(frame(-(k - 2)))
    roll = full(2 * F.sqrt(F.greatest(-covariance, F.lit(0.0))), "ret", k, keys)
    ratio = full(divide(F.var_samp("_sum5").over(frame(-(k - 5))), 5 * F.var_samp("ret").over(keys.last(k))), "ret", k, keys)
    fast, slow = ewma_std("ret", 5, keys), ewma_std("ret", 30, keys)
    columns = {
        "roll_spread": F.coalesce(roll, F.lit(0.0)),
        "variance_ratio": F.coalesce(ratio, F.lit(1.0)),
        **{f"rv_{n}": full(F.sqrt(F.sum(r * r).over(keys.last(n))), "ret", n, keys) for n in signature},
        "ewma_fast": fast,
        "ewma_slow": slow,
        **{f"{n}_{x}": F.coalesce(f(c, k, keys), F.lit(0.0)) for n, c in (("ret", "ret"), ("vol", "_vol")) for x, f in (("skew", rolling_skew), ("kurt", rolling_kurtosis))},
        **{f"ret_acf_{n}": F.coalesce(full(correlation("ret", f"_r{n}", frame(-(k - 1 - n))), "ret", k, keys), F.lit(0.0)) for n in lags},
        **{f"vol_acf_{n}": F.coalesce(full(correlation("_vol", f"_v{n}", frame(-(k - 1 - n))), "_vol", k, keys), F.lit(0.0)) for n in lags},
    }
    out = out.withColumns(columns).withColumn("vol_regime", F.coalesce(divide(F.col("ewma_fast"), F.col("ewma_slow")), F.lit(1.0)))
    return out.drop("_prev", "_sum5", "_vol", *[f"_{x}{n}" for x in "rv" for n in lags])


def with_vpin(trades: DataFrame, side: str = "side", size: str = "size", buckets: int = 50, k: int = 10, keys: Keys = KEYS, bucket_volume: float | None = None, width: float = DAY) -> DataFrame:
    """Trades with volume_bucket and vpin: the mean over k buckets of |buys - sells| by volume, each bucket a share of the volume.

    Without bucket_volume a bucket is 1/buckets of all the symbol's volume, which looks ahead. The rolling mean runs over the table of buckets, and the
    volume so far is a scan over time buckets of `width` seconds.
    """
    whole = trades if bucket_volume else with_totals(trades, {"_all": F.sum(size)}, keys)
    sized = F.lit(bucket_volume) if bucket_volume else F.col("_all") / buckets
    marked = with_running(whole, {"_so_far": Running("sum", size)}, width, keys).withColumn("volume_bucket", F.floor(divide(F.col("_so_far"), sized))).drop("_so_far", "_all")
    sums = marked.groupBy(keys.symbol, "volume_bucket").agg(F.sum(F.when(F.col(side) > 0, F.col(size)).otherwise(0)).alias("_b"), F.sum(F.when(F.col(side) < 0, F.col(size)).otherwise(0)).alias("_s"), F.sum(size).alias("_n"))
    frame = Window.partitionBy(keys.symbol).orderBy("volume_bucket").rowsBetween(-(k - 1), 0)
    each = sums.select(keys.symbol, "volume_bucket", F.avg(divide(F.abs(F.col("_b") - F.col("_s")), F.col("_n"))).over(frame).alias("vpin"))
    return marked.join(each, [keys.symbol, "volume_bucket"], "left")


def run_length(state: str, keys: Keys = KEYS, first: int = 0) -> Column:
    """Expression over a column _run (see with_run_length)."""
    rows = F.row_number().over(Window.partitionBy(keys.symbol, "_run").orderBy(keys.ts, keys.seq))
    return F.when(F.col("_run") == 0, rows - 1 + first).otherwise(rows)


def with_run_length(df: DataFrame, state: str, name: str = "run_length", keys: Keys = KEYS, first: int = 0) -> DataFrame:
    """df with the length so far of the current run of equal states. The first run of a series counts from `first`, later ones from 1."""
    new = F.coalesce((~F.col(state).eqNullSafe(F.lag(state).over(keys.ordered()))) & (F.row_number().over(keys.ordered()) > 1), F.lit(False))
    numbered = df.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(keys.so_far()))
    return numbered.withColumn(name, run_length(state, keys, first)).drop("_new", "_run")


def drawdown(value: str, keys: Keys = KEYS) -> Column:
    """Value below its running maximum, as a share of it."""
    top = F.max(value).over(keys.so_far())
    return divide(F.col(value) - top, top)


def centred_mean(x: str, k: int = 10, keys: Keys = KEYS) -> Column:
    """Mean of k rows around the current one; null where fewer are there."""
    frame = keys.ordered().rowsBetween(-(k // 2), k - k // 2 - 1)
    return F.when(F.count(x).over(frame) >= k, F.avg(x).over(frame))


def full_window(aggregate: Callable[[Column], Column], x: Column, rows: int, keys: Keys = KEYS) -> Column:
    """An aggregate of x over the last rows, null until there are so many with a value."""
    last = keys.last(rows)
    return F.when(F.count(x).over(last) >= rows, aggregate(x).over(last))


def book_dynamics(levels: int, window: int = 20, lag: int = 1, top: int = 1, windows: tuple[int, ...] = (10, 30, 60), keys: Keys = KEYS) -> dict[str, Column]:
    """Rolling and lagged columns of an order book: volatility of the first level's imbalance, means and acceleration of the volume difference, volatility and change of thickness, change of concentration."""
    before = lambda x, k: x - F.lag(x, k).over(keys.ordered())
    difference, thick, top_share = book.volume_difference(levels), book.thickness(levels), book.concentration(top, levels)
    return {
        "queue_imbalance_volatility": full_window(F.stddev_samp, book.level_imbalance(1), window, keys), "volume_difference_mean": full_window(F.avg, difference, window, keys),
        **{f"volume_difference_mean_{k}": full_window(F.avg, difference, k, keys) for k in windows}, "volume_difference_acceleration": before(difference, window),
        "thickness_volatility": full_window(F.stddev_samp, thick, window, keys), "thickness_change": before(thick, lag), "concentration_change": before(top_share, window),
    }


def relative_volume(volume: str = "volume", rows: int = 5, keys: Keys = KEYS) -> dict[str, Column]:
    """volume_relative: by the symbol's mean over all rows (it looks ahead); volume_concentration: by the mean of the last rows, null until there are so many. NaN where all these volumes are 0."""
    v = F.col(volume).cast("double")
    return {"volume_relative": quotient(v, F.avg(v).over(keys.whole())), "volume_concentration": quotient(v, full_window(F.avg, v, rows, keys))}
