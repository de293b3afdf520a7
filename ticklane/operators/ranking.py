"""Small result tables: rankings, frontiers, merged importances, transitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import divide
from .keys import KEYS, Keys


def ranked(importance: DataFrame, value: str = "importance", name: str = "feature", top: int | None = None) -> DataFrame:
    """One row per feature with rank and cumulative share, equal values by name. For tables of features: the window is one task."""
    order = Window.orderBy(F.desc(value), name)
    share = divide(F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.sum(value).over(Window.partitionBy(F.lit(1))))
    out = importance.withColumns({"rank": F.row_number().over(order), "cumulative_share": share})
    return out.where(F.col("rank") <= top) if top else out


def concentration(importance: DataFrame, percents: tuple[int, ...] = (10, 20, 50), value: str = "importance") -> DataFrame:
    """(percent, share): what the top ceil(n * percent / 100) features hold."""
    n = importance.count()
    rows = ranked(importance, value)
    picks = [F.max(F.when(F.col("rank") == max(1, -(-n * p // 100)), F.col("cumulative_share"))).alias(str(p)) for p in percents]
    return rows.agg(*picks).select(F.explode(F.array(*[F.struct(F.lit(p).alias("percent"), F.col(str(p)).alias("share")) for p in percents])).alias("r")).select("r.*")


def merged_importances(tables: dict[str, DataFrame], how: str = "outer", name: str = "feature", value: str = "importance") -> DataFrame:
    """Tables joined by feature, each scaled to sum 1 (absent: 0), with their mean."""
    named = [df.select(name, F.col(value).alias(n)) for n, df in tables.items()]
    both = reduce(lambda a, b: a.join(b, name, how), named).fillna(0, list(tables))
    whole = Window.partitionBy(F.lit(1))
    scaled = both.withColumns({n: F.coalesce(divide(F.col(n), F.sum(n).over(whole)), F.lit(0.0)) for n in tables})
    return scaled.withColumn("mean", reduce(lambda a, b: a + b, map(F.col, tables)) / len(tables))


def pareto(results: DataFrame, up: str = "accuracy", down: str = "latency") -> DataFrame:
    """Rows that no other row beats: at least as good in both and better in one. Scanned in order of latency against the best so far; for tables of results."""
    order = Window.orderBy(down)
    below = F.max(up).over(order.rangeBetween(Window.unboundedPreceding, 0))
    cheaper = F.min(F.when(F.col(up) == F.col("_best"), F.col(down))).over(Window.partitionBy("_best"))
    best = results.withColumn("_best", below).where(F.col(up) == F.col("_best"))
    return best.withColumn("_least", cheaper).where(F.col(down) == F.col("_least")).drop("_best", "_least")


def recommended(results: DataFrame, least_accuracy: float, most_latency: float, up: str = "accuracy", down: str = "latency") -> DataFrame:
    """The most accurate row within both limits; without one, the row of the least penalty 100 * missing accuracy + excess latency / 10."""
    fits = (F.col(up) >= least_accuracy) & (F.col(down) <= most_latency)
    penalty = 100 * F.greatest(F.lit(0.0), least_accuracy - F.col(up)) + F.greatest(F.lit(0.0), F.col(down) - most_latency) / 10
    return results.orderBy(F.desc(fits), F.when(fits, -F.col(up)).otherwise(penalty), down).limit(1)


def transitions(rows: DataFrame, state: str, keys: Keys = KEYS) -> DataFrame:
    """(before, state, n, probability): counts of a state after another within a symbol."""
    pairs = rows.select(F.lag(state).over(keys.ordered()).alias("before"), F.col(state)).where("before is not null")
    counts = pairs.groupBy("before", state).agg(F.count("*").alias("n"))
    return counts.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy("before")))
