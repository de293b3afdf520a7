"""Data quality, summaries and outliers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import correlation, divide, seconds_between, unbiased_kurtosis, unbiased_skew
from . import order_stats
from .keys import KEYS, Keys
from .lineage import materialised

PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, x): the columns under each other."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("r")).select("r.*")


def summary_stats(df: DataFrame, columns: list[str], percentiles: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """One row per column: counts, moments (bias-corrected), exact percentiles, range, IQR, variation, outliers beyond 1.5 IQR and distinct values. Percentiles and distinct values come from counted values in ranges (see order_stats)."""
    rows = long_form(df, columns)
    n, x = F.count("x"), F.col("x")
    base = rows.groupBy("feature").agg(
        F.count("*").alias("rows"), n.alias("count"), F.sum(x.isNull().cast("long")).alias("missing"), F.sum((x == 0).cast("long")).alias("n_zeros"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"),
        unbiased_skew(n, F.skewness("x")).alias("skew"), unbiased_kurtosis(n, F.kurtosis("x")).alias("kurtosis"),
    )
    counts = materialised(rows.where(x.isNotNull()).groupBy("feature", "x").agg(F.count("*").alias("w")))
    placed = order_stats.percentiles(counts, "x", {f"p{round(100 * p)}": p for p in percentiles}, ["feature"], "w").drop("n")
    base = base.join(F.broadcast(placed), "feature", "left").withColumn("n_unique", F.coalesce("n_unique", F.lit(0).cast("long")))
    base = base.withColumns({"range": F.col("max") - F.col("min"), "iqr": F.col("p75") - F.col("p25"), "cv": divide(F.col("std"), F.col("mean")), "missing_pct": divide(F.col("missing") * 100.0, F.col("rows").cast("double"))})
    low, high = F.col("p25") - 1.5 * F.col("iqr"), F.col("p75") + 1.5 * F.col("iqr")
    # One bounds row per column: small by construction.
    base = materialised(base)
    out = counts.join(F.broadcast(base.select("feature", "p25", "p75", "iqr")), "feature").groupBy("feature").agg(F.sum(F.when((x < low) | (x > high), F.col("w")).otherwise(0)).alias("n_outliers"))
    return base.join(out, "feature", "left").withColumn("n_outliers", F.when(F.col("count") > 0, F.col("n_outliers"))).withColumn("outlier_pct", divide(F.col("n_outliers") * 100.0, F.col("count").cast("double")))


def flags(summary: DataFrame) -> DataFrame:
    """Columns of summary_stats that call for attention."""
    tests = {"has_missing": F.col("missing") > 0, "many_outliers": F.col("outlier_pct") > 5, "skewed": F.abs(F.col("skew")) > 2, "heavy_tails": F.col("kurtosis") > 5, "near_constant": F.abs(F.col("cv")) < 0.01}
    return summary.select("feature", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in tests.items()])


def without_outliers(df: DataFrame, columns: list[str], method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """Rows inside the bounds of each column; bounds are taken on the rows that earlier columns left, null values stay. The bounds are one row per column, taken to the driver."""
    for c in columns:
        x = F.col(c)
        if method == "iqr":
            a, b = order_stats.percentiles(df, c, {"a": 0.25, "b": 0.75}, []).agg(F.first("a"), F.first("b")).first()
            low, high = (None, None) if a is None else (a - threshold * (b - a), b + threshold * (b - a))
        elif method == "zscore":
            mean, std = df.agg(F.avg(c), F.stddev_samp(c)).first()
            low, high = (None, None) if not std else (mean - threshold * std, mean + threshold * std)
        else:
            raise ValueError(f"unknown method {method!r}")
        if low is not None:
            df = df.where(x.isNull() | x.between(low, high))
    return df


def gaps(df: DataFrame, most: float = 60.0, keys: Keys = KEYS) -> DataFrame:
    """(symbol, gap_start, gap_end, gap_seconds) of pauses of more than `most` seconds."""
    before = F.lag(keys.ts).over(keys.ordered())
    return df.select(keys.symbol, before.alias("gap_start"), F.col(keys.ts).alias("gap_end")).withColumn("gap_seconds", seconds_between("gap_start", "gap_end")).where(F.col("gap_seconds") > most)


def quality_report(df: DataFrame, columns: list[str], keys: Keys = KEYS) -> DataFrame:
    """One row: rows, distinct rows, time range, gap statistics and missing values per column."""
    gapped = df.withColumn("_gap", seconds_between(F.lag(keys.ts).over(keys.ordered()), keys.ts))
    median = order_stats.percentiles(gapped.select("_gap"), "_gap", {"gap_median": 0.5}, []).agg(F.first("gap_median").alias("gap_median"))
    return gapped.join(F.broadcast(median), F.lit(True)).agg(
        F.count("*").alias("rows"), F.min(keys.ts).alias("first_ts"), F.max(keys.ts).alias("last_ts"), F.first("gap_median").alias("gap_median"), F.avg("_gap").alias("gap_mean"), F.max("_gap").alias("gap_max"),
        *[F.sum(F.col(c).isNull().cast("long")).alias(f"{c}_missing") for c in columns], *[F.sum((F.col(c) < 0).cast("long")).alias(f"{c}_negative") for c in columns],
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that occur more than once, with their number."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("n")).where("n > 1")


def correlations(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """(a, b, correlation) for each pair of columns, from one aggregation; spearman ranks each column first."""
    if method == "spearman":
        for c in columns:
            df = order_stats.mean_ranks(df, c)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), correlation(a, b).alias("correlation")) for a, b in pairs]).alias("r"))
    return one.select(F.explode("r").alias("r")).select("r.*")


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share): counts of a column's values and their share in percent. The window runs over the table of values."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1))))


def row_shares(df: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """Crosstab: per value of `rows` the percentage of each of the given values of `columns`."""
    counts = [F.sum((F.col(columns) == v).cast("long")) for v in values]
    total = reduce(lambda a, b: a + b, counts)
    return df.groupBy(rows).agg(*[F.coalesce(divide(c * 100.0, total.cast("double")), F.lit(0.0)).alias(v) for c, v in zip(counts, values)])


def group_stats(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Mean, deviation, least and greatest of columns by group."""
    return df.groupBy(group).agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])
