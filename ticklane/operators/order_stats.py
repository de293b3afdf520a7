"""Running sums, ranks and exact percentiles in order of a value, without a task that sees all rows.

Values are counted first. Approximate quantiles (a mergeable sketch, a few numbers per group) cut them into ranges, sums per
range are carried on in a table of a few rows per group, and each range is finished on its own. Null values are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import materialised

#: Ranges of a group.
RANGES = 32


def running(rows: DataFrame, value: str, sums: dict[str, Column], by: list[str], ranges: int = RANGES) -> DataFrame:
    """(by, value, each of sums, each of sums with the suffix _below): aggregates of the rows of each distinct value, and their totals over all smaller ones."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(*[c.alias(n) for n, c in sums.items()])
    keys = by or ["_all"]
    counts = materialised(counts if by else counts.withColumn("_all", F.lit(0)))  # it is read three times
    small = (lambda df: df) if by else F.broadcast  # groups may be many; without them the tables have a row or a row per range
    shares = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(value, shares, F.lit(1000)).alias("_cuts"))
    passed = [F.coalesce((F.get("_cuts", F.lit(k)) < F.col(value)).cast("int"), F.lit(0)) for k in range(ranges - 1)]  # a sum of plain terms is compiled
    ranged = counts.join(small(cuts), keys).withColumn("_range", reduce(lambda a, b: a + b, passed)).drop("_cuts")
    totals = ranged.groupBy(*keys, "_range").agg(*[F.sum(n).alias(n) for n in sums])
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    start = totals.select(*keys, "_range", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}") for n in sums])
    smaller = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    made = ranged.join(small(start), [*keys, "_range"])
    made = made.withColumns({f"{n}_below": F.col(f"_{n}") + F.coalesce(F.sum(n).over(smaller), F.lit(0)) for n in sums})
    return made.drop("_range", *([] if by else ["_all"]), *[f"_{n}" for n in sums])


def percentiles(rows: DataFrame, value: str, shares: dict[str, float], by: list[str], weight: str | None = None) -> DataFrame:
    """(by, one column per share, n, n_unique): exact percentiles, linear between the two nearest values, of the values that are not null. weight: how many values a row stands for."""
    placed = running(rows, value, {"n": F.sum(weight) if weight else F.count("*")}, by)
    sizes = placed.groupBy(*by).agg(F.sum("n").alias("_n"), F.count("*").alias("n_unique"))
    every = placed.join(sizes, by) if by else placed.join(F.broadcast(sizes), F.lit(True))
    at = lambda k: F.min(F.when((F.col("n_below") <= k) & (k < F.col("n_below") + F.col("n")), F.col(value)))
    picks = []
    for name, share in shares.items():
        place = F.lit(share) * (F.col("_n") - 1)
        picks += [at(F.floor(place)).alias(f"_{name}_low"), at(F.ceil(place)).alias(f"_{name}_high")]
    found = every.groupBy(*by).agg(F.first("_n").alias("n"), F.first("n_unique").alias("n_unique"), *picks)
    part = lambda share: F.lit(share) * (F.col("n") - 1) - F.floor(F.lit(share) * (F.col("n") - 1))
    between = [((1 - part(share)) * F.col(f"_{name}_low") + part(share) * F.col(f"_{name}_high")).alias(name) for name, share in shares.items()]
    return found.select(*by, *between, "n", "n_unique")


def mean_ranks(df: DataFrame, column: str) -> DataFrame:
    """df with the column replaced by its rank from 1, equal values by their mean rank, nulls kept."""
    ranks = running(df, column, {"n": F.count("*")}, []).select(F.col(column), (F.col("n_below") + (F.col("n") + 1) / 2).alias("_rank"))
    return df.join(ranks, column, "left").withColumn(column, F.col("_rank")).drop("_rank")
