"""Self-exciting point processes with intensity mu + sum of alpha * exp(-beta * age), branching ratio alpha / beta.

Windows of events are fitted by expectation-maximisation in a grouped function, a few hundred successive ones at once, each step
for all of them; groups of all symbols run in parallel.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import seconds
from . import order_stats
from .keys import KEYS, Keys
from .lineage import materialised
from .scan import Running, with_running, with_totals


@dataclass(frozen=True)
class Parameters:
    """A fitted process: base rate, jump and decay."""

    mu: float
    alpha: float
    beta: float

    @property
    def branching_ratio(self) -> float:
        return self.alpha / self.beta if self.beta else 0.0

    def features(self) -> dict[str, float]:
        return {"mu": self.mu, "alpha": self.alpha, "beta": self.beta, "branching_ratio": self.branching_ratio, "half_life": math.log(2) / self.beta if self.beta else math.inf}


def excitation(gaps: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """gaps: (events, windows), beta: (windows). Per event the sums over earlier events of exp(-beta * age) and age * exp(-beta * age), all windows at once."""
    a, b = np.zeros_like(gaps), np.zeros_like(gaps)
    fade = np.exp(-beta * gaps)
    for i in range(1, len(gaps)):
        more = 1 + a[i - 1]
        a[i] = fade[i] * more
        b[i] = fade[i] * (b[i - 1] + gaps[i] * more)
    return a, b


def fit_all(times: np.ndarray, rounds: int = 100, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """mu, alpha, beta and whether the fit came to rest, for each row of sorted times; edge effects at the end of a window are left out."""
    gaps = np.diff(times, prepend=times[:, :1], axis=1).T.copy()
    n = len(gaps)
    span = np.maximum(times[:, -1] - times[:, 0], 1e-9)
    mu, ratio, beta = 0.5 * n / span, np.full(len(times), 0.5), n / span
    done = np.zeros(len(times), bool)
    for _ in range(rounds):
        at = np.flatnonzero(~done)
        if not len(at):
            break
        a, b = excitation(gaps[:, at], beta[at])
        rate = mu[at] + ratio[at] * beta[at] * a
        caused = (ratio[at] * beta[at] * a / rate).sum(0)
        age = (ratio[at] * beta[at] * b / rate).sum(0)
        new = ((mu[at] / rate).sum(0) / span[at], caused / n, np.where(age > 0, caused / np.where(age > 0, age, 1), beta[at]))
        moved = np.max([np.abs(x - y[at]) / np.maximum(np.abs(y[at]), 1e-12) for x, y in zip(new, (mu, ratio, beta))], axis=0)
        mu[at], ratio[at], beta[at] = new
        done[at] = moved < tolerance
    return mu, ratio * beta, beta, done


def fit(times: np.ndarray, rounds: int = 100, tolerance: float = 1e-6) -> tuple[float, float, float]:
    """(mu, alpha, beta) of sorted times."""
    mu, alpha, beta, _ = fit_all(np.asarray(times, float)[None], rounds, tolerance)
    return float(mu[0]), float(alpha[0]), float(beta[0])


#: Windows of a symbol that are fitted together; their events go to one group once.
TOGETHER = 256


def rolling_fit(events: DataFrame, size: int = 200, stride: int = 20, least: int = 50, rounds: int = 50, keys: Keys = KEYS) -> DataFrame:
    """(symbol, window, start, end, n_events, mu, alpha, beta, converged, branching_ratio) for every whole window of `size` events, `stride` apart; symbols with fewer than `size` events give one window if they have `least`."""
    counted = with_totals(events.select(keys.symbol, keys.ts, keys.seq, seconds(keys.ts).alias("_t")), {"_n": F.count("*")}, keys).where(F.col("_n") >= least)
    numbered = with_running(counted, {"_i": Running("count")}, keys=keys).drop(keys.seq)
    last = F.greatest(F.lit(0), F.floor((F.col("_n") - size) / stride))
    first_in, last_in = F.greatest(F.lit(0), F.ceil((F.col("_i") - size) / stride)), F.least(F.floor((F.col("_i") - 1) / stride), last)
    dealt = numbered.where(first_in <= last_in).withColumn("_block", F.explode(F.sequence(F.floor(first_in / TOGETHER).cast("long"), F.floor(last_in / TOGETHER).cast("long"))))
    kind = dealt.schema[keys.symbol].dataType.simpleString(), dealt.schema[keys.ts].dataType.simpleString()

    def block(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_i")
        n, t, at = int(g["_n"].iloc[0]), g["_t"].to_numpy(), g["_i"].to_numpy()
        wide, final = min(size, n), max(0, (n - size) // stride)
        window = np.arange(g["_block"].iloc[0] * TOGETHER, min(final, (g["_block"].iloc[0] + 1) * TOGETHER - 1) + 1)
        begin = window * stride + 1 - at[0]
        times = t[begin[:, None] + np.arange(wide)]
        mu, alpha, beta, done = fit_all(times - times[:, :1], rounds)
        stamps = g[keys.ts].to_numpy()
        return pd.DataFrame({keys.symbol: g[keys.symbol].iloc[0], "window": window, "start": stamps[begin], "end": stamps[begin + wide - 1], "n_events": wide, "mu": mu, "alpha": alpha, "beta": beta, "converged": done})

    made = dealt.groupBy(keys.symbol, "_block").applyInPandas(block, f"{keys.symbol} {kind[0]}, window long, start {kind[1]}, end {kind[1]}, n_events long, mu double, alpha double, beta double, converged boolean")
    return made.withColumn("branching_ratio", branching_ratio())


def branching_ratio(alpha: str = "alpha", beta: str = "beta") -> Column:
    return F.when(F.col(beta) > 0, F.col(alpha) / F.col(beta)).otherwise(0.0)


def intensity(events: DataFrame, mu: float, alpha: float, beta: float, keys: Keys = KEYS) -> DataFrame:
    """events with the intensity just before each one, summed over all strictly earlier events.

    Sums are kept relative to the start of a symbol's time bucket: what the buckets before left is carried along the table
    of buckets, the rest is a running sum within the bucket. A bucket has at most an hour, and at most 32 times the memory 1 / beta, so powers stay small.
    """
    width = max(1, int(min(3600.0, 32 / beta if beta > 0 else 3600.0) * 1e6))
    us = F.unix_micros(F.col(keys.ts).cast("timestamp"))
    placed = events.withColumn("_us", us).withColumn("_start", F.col("_us") - F.pmod("_us", F.lit(width).cast("long")))
    age = beta * (F.col("_us") - F.col("_start")) / 1e6
    kind = events.schema[keys.symbol].dataType.simpleString()
    totals = placed.where(F.col("_us").isNotNull()).groupBy(F.col(keys.symbol).alias("_symbol"), F.col("_start").alias("_at")).agg(F.sum(F.exp(age)).alias("_sum"))

    def carry(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_at")
        left = np.exp(-beta * np.diff(g["_at"].to_numpy()) / 1e6)
        carried, s = [0.0], 0.0
        for k, x in zip(left.tolist(), g["_sum"].tolist()):
            s = k * (s + x)
            carried.append(s)
        return pd.DataFrame({"_symbol": g["_symbol"], "_at": g["_at"], "_carried": carried})

    carried = totals.groupBy("_symbol").applyInPandas(carry, f"_symbol {kind}, _at long, _carried double")
    both = placed.join(carried, F.col(keys.symbol).eqNullSafe(F.col("_symbol")) & (F.col("_start") == F.col("_at")), "left")
    earlier = F.sum(F.exp(age)).over(Window.partitionBy(keys.symbol, "_start").orderBy("_us").rangeBetween(Window.unboundedPreceding, -1))
    summed = F.exp(-age) * (F.coalesce(earlier, F.lit(0.0)) + F.coalesce("_carried", F.lit(0.0)))
    return both.withColumn("intensity", mu + alpha * F.coalesce(summed, F.lit(0.0))).drop("_us", "_start", "_symbol", "_at", "_carried")


def simulate(mu: float, alpha: float, beta: float, until: float, seed: int = 42) -> np.ndarray:
    """Event times by thinning; the bound follows the intensity."""
    r, t, s, out = np.random.default_rng(seed), 0.0, 0.0, []
    while True:
        bound = mu + alpha * s
        step = r.exponential(1 / bound)
        t += step
        if t > until:
            return np.array(out)
        s *= math.exp(-beta * step)
        if r.random() * bound <= mu + alpha * s:
            out.append(t)
            s += 1


def _uniform(*keys: Column | str) -> Column:
    """A number in (0, 1) from a hash of the keys, the same wherever the row stands."""
    return (F.xxhash64(*keys) / F.lit(2.0**64) + 0.5 + F.lit(2.0**-54)).cast("double")


#: Poisson counts of mean m by inversion: the number of partial sums of probabilities that a uniform number exceeds; beyond so many terms nothing is left of means up to 8.
_TERMS = 64


def _poisson(u: Column, mean: float) -> Column:
    shares, p, total = [], math.exp(-mean), 0.0
    for k in range(_TERMS):
        total += p
        shares.append(total)
        p *= mean / (k + 1)
    return F.aggregate(F.array(*map(F.lit, shares)), F.lit(0), lambda n, share: n + (u > share).cast("int"))


def simulated(spark: SparkSession, mu: float, alpha: float, beta: float, until: float, series: int = 1, seed: int = 42, cell: float | None = None, most: int = 10_000) -> DataFrame:
    """(series, generation, t): events of branching processes over (0, until), by generations.

    Immigrants come at rate mu, in cells of time of about four of them, so that every cell draws on its own; each event has Poisson(alpha / beta)
    offspring at exponential ages. A generation is one step over the table of the one before, until none is left (the branching ratio must lie below 1).
    Every number is drawn from a hash of seed, series and the event's line of descent: the same events come out of any partitioning.
    """
    ratio = alpha / beta
    if not 0 <= ratio < 1:
        raise ValueError("the branching ratio alpha / beta must lie below 1")
    width = cell or min(until, 4 / mu if mu > 0 else until)
    cells = math.ceil(until / width)
    places = spark.range(series * cells).select(F.floor(F.col("id") / cells).alias("series"), (F.col("id") % cells).alias("_cell"))
    born = places.withColumn("_n", _poisson(_uniform(F.lit(seed), F.lit("immigrants"), "series", "_cell"), mu * width)).where("_n > 0")
    each = born.withColumn("_k", F.explode(F.sequence(F.lit(1), "_n")))
    line = F.xxhash64(F.lit(seed), "series", "_cell", "_k")
    living = each.select("series", F.lit(0).alias("generation"), ((F.col("_cell") + _uniform(F.lit(seed), F.lit("time"), line)) * width).alias("t"), line.alias("_line")).where(F.col("t") < until)
    generation, out = 0, None
    while True:
        living = materialised(living)
        out = living if out is None else out.union(living)
        generation += 1
        if generation > most or not living.limit(1).count():
            return out.select("series", "generation", "t")
        parents = living.withColumn("_n", _poisson(_uniform(F.lit(seed), F.lit("offspring"), "_line"), ratio)).where("_n > 0")
        children = parents.withColumn("_k", F.explode(F.sequence(F.lit(1), "_n"))).withColumn("_line", F.xxhash64(F.lit(seed), "_line", "_k"))
        age = -F.log(_uniform(F.lit(seed), F.lit("age"), "_line")) / beta
        living = children.select("series", F.lit(generation).alias("generation"), (F.col("t") + age).alias("t"), "_line").where(F.col("t") < until)


def excited(ratio: str = "branching_ratio", threshold: float = 0.7) -> Column:
    return (F.col(ratio) > threshold).cast("int")


def excited_adaptive(ratio: str = "branching_ratio", keys: Keys = KEYS) -> Column:
    """1 above the symbol's mean plus one population deviation."""
    return (F.col(ratio) > F.avg(ratio).over(keys.whole()) + F.stddev_pop(ratio).over(keys.whole())).cast("int")


def regime_label(ratio: str = "branching_ratio", low: float = 0.3, high: float = 0.7) -> Column:
    return F.when(F.col(ratio) >= high, "Excited").when(F.col(ratio) >= low, "Normal").otherwise("Calm")


def quantile_regime(windows: DataFrame, ratio: str = "branching_ratio") -> DataFrame:
    """windows with High Excitation from the 75th, Moderate from the 50th percentile of all, else Baseline. The percentiles are one row, found in ranges of values."""
    cuts = order_stats.percentiles(windows, ratio, {"_high": 0.75, "_mid": 0.5}, []).agg(F.first("_high").alias("_high"), F.first("_mid").alias("_mid"))
    label = F.when(F.col(ratio) >= F.col("_high"), "High Excitation").when(F.col(ratio) >= F.col("_mid"), "Moderate").otherwise("Baseline")
    return windows.join(F.broadcast(cuts)).withColumn("regime_hawkes", label).drop("_high", "_mid")


def bursts(times: float = 2.0, keys: Keys = KEYS) -> Column:
    """Windows whose base rate exceeds the symbol's mean by a multiple of the deviation."""
    whole = Window.partitionBy(keys.symbol)
    return F.col("mu") > F.avg("mu").over(whole) + times * F.stddev_pop("mu").over(whole)


def in_bursts(events: DataFrame, windows: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """events with is_burst: whether they lie in a window (symbol, start, end, is_burst) that is one. A scan over the bounds and events in order counts the bursts that are open; no event meets every window."""
    marks = windows.where("is_burst").select(keys.symbol, F.explode(F.array(F.struct(F.col("start").alias(keys.ts), F.lit(1).alias("_step"), F.lit(0).alias("_rank")), F.struct(F.col("end").alias(keys.ts), F.lit(-1).alias("_step"), F.lit(2).alias("_rank")))).alias("m")).select(keys.symbol, "m.*")
    own = F.struct(*[F.col(c) for c in events.columns]).alias("_event")
    both = events.select(keys.symbol, keys.ts, F.lit(0).alias("_step"), F.lit(1).alias("_rank"), own).unionByName(marks, allowMissingColumns=True)
    counted = with_running(both, {"_open": Running("sum", "_step")}, keys=Keys(keys.symbol, keys.ts, "_rank"))
    return counted.where(F.col("_event").isNotNull()).select("_event.*", (F.col("_open") > 0).alias("is_burst"))
