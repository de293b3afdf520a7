"""Time buckets: resampling, dense timelines and fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import divide, quotient, seconds_between
from .keys import KEYS, Keys


#: Buckets of a timeline made from one row.
PART = 10_000


def bucket_start(ts: str, every: int) -> Column:
    """Start of the bucket of `every` seconds, counted from 1970."""
    second = F.unix_seconds(F.col(ts).cast("timestamp"))
    return F.timestamp_seconds(second - F.pmod(second, F.lit(every))).cast("timestamp_ntz")


def ohlc(trades: DataFrame, every: int, price: str = "price", size: str = "size", keys: Keys = KEYS) -> DataFrame:
    """Bars (symbol, ts, open, high, low, close, volume, vwap, trades), one for each bucket with a trade. The vwap of no volume is NaN."""
    order = F.struct(keys.ts, keys.seq)
    start = bucket_start(keys.ts, every)
    volume = F.sum(size)
    bars = trades.groupBy(keys.symbol, start.alias("_start")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"),
        volume.alias("volume"), quotient(F.sum(F.col(price) * F.col(size)), volume).alias("vwap"), F.count("*").alias("trades"),
    )
    return bars.withColumnRenamed("_start", keys.ts)


def last_values(rows: DataFrame, every: int, columns: list[str], keys: Keys = KEYS) -> DataFrame:
    """For each bucket the last value of each column that is not null."""
    order = F.struct(keys.ts, keys.seq)
    picked = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns]
    return rows.groupBy(keys.symbol, bucket_start(keys.ts, every).alias("_start")).agg(*picked).withColumnRenamed("_start", keys.ts)


def aggregated(rows: DataFrame, every: int, columns: dict[str, Column], keys: Keys = KEYS) -> DataFrame:
    """For each bucket the given aggregates."""
    start = bucket_start(keys.ts, every)
    return rows.groupBy(keys.symbol, start.alias("_start")).agg(*[c.alias(n) for n, c in columns.items()]).withColumnRenamed("_start", keys.ts)


def timeline(rows: DataFrame, every: int, keys: Keys = KEYS) -> DataFrame:
    """(symbol, ts): every bucket from the symbol's first to its last. They are dealt out ten thousand at a time, so a long series is not one array."""
    ends = rows.groupBy(keys.symbol).agg(F.min(bucket_start(keys.ts, every)).alias("_a"), F.max(bucket_start(keys.ts, every)).alias("_b"))
    last = F.floor(seconds_between("_a", "_b") / every)
    parts = ends.withColumn("_last", last).where("_last is not null").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / PART))))
    numbered = parts.withColumn("_n", F.explode(F.sequence(F.col("_part") * PART, F.least("_last", F.col("_part") * PART + PART - 1))))
    return numbered.select(keys.symbol, (F.col("_a") + F.make_dt_interval(secs=F.col("_n") * every)).alias(keys.ts))


def dense(buckets: DataFrame, every: int, zeros: list[str] = (), keys: Keys = KEYS) -> DataFrame:
    """buckets with a row for every empty bucket in between; `zeros` are 0 there, other columns null."""
    full = timeline(buckets, every, keys).join(buckets, [keys.symbol, keys.ts], "left")
    return full.fillna(0, list(zeros)) if zeros else full


def filled(rows: DataFrame, columns: list[str], method: str = "ffill", keys: Keys = KEYS) -> DataFrame:
    """rows with nulls of the columns filled: ffill, bfill, both (forward, then backward), or linear in the row number."""
    order = Window.partitionBy(keys.symbol).orderBy(keys.ts)
    past, future = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    ahead = lambda c: F.last(c, ignorenulls=True).over(past)
    back = lambda c: F.first(c, ignorenulls=True).over(future)
    if method == "linear":
        at = F.row_number().over(order)
        rows = rows.withColumn("_at", at)
        for c in columns:
            place = F.when(F.col(c).isNotNull(), F.col("_at"))
            lo, hi = F.last(place, ignorenulls=True).over(past), F.first(place, ignorenulls=True).over(future)
            share = F.coalesce(divide(F.col("_at") - lo, hi - lo), F.lit(0.0))
            rows = rows.withColumn(f"_{c}", F.coalesce(ahead(c) + share * (back(c) - ahead(c)), ahead(c)))
        return rows.withColumns({c: F.col(f"_{c}") for c in columns}).drop("_at", *[f"_{c}" for c in columns])
    made = {"ffill": ahead, "bfill": back, "both": lambda c: F.coalesce(ahead(c), back(c))}
    if method not in made:
        raise ValueError(f"unknown method {method!r}")
    return rows.withColumns({c: made[method](c) for c in columns})


def unified_timeline(trades: DataFrame, quotes: DataFrame, every: int, quote_columns: list[str], method: str = "ffill", keys: Keys = KEYS) -> DataFrame:
    """A dense timeline of buckets with mean trade price, total size and last quotes; gaps of prices and quotes are filled."""
    spans = timeline(trades.select(keys.symbol, keys.ts).union(quotes.select(keys.symbol, keys.ts)), every, keys)
    t = aggregated(trades, every, {"avg_trade_price": F.avg("price"), "total_trade_volume": F.sum("size")}, keys)
    q = last_values(quotes, every, quote_columns, keys)
    both = spans.join(t, [keys.symbol, keys.ts], "left").join(q, [keys.symbol, keys.ts], "left")
    return filled(both, ["avg_trade_price", *quote_columns], method, keys)


def unified_dataset(trades: DataFrame, sides: dict[str, tuple[DataFrame, list[str]]], every: int, method: str = "ffill", keys: Keys = KEYS) -> DataFrame:
    """A dense timeline of buckets with mean trade price, total size and, of any number of further tables (name -> table, columns), the last values; gaps of prices and values are filled. Column names must differ.

    All tables are united and aggregated in one shuffle, instead of a join per table.
    """
    start = lambda df: bucket_start(keys.ts, every).alias("_start")
    both = trades.select(keys.symbol, keys.ts, keys.seq, start(trades), F.col("price").alias("_price"), F.col("size").alias("_size"))
    columns = [c for _, names in sides.values() for c in names]
    for df, names in sides.values():
        both = both.unionByName(df.select(keys.symbol, keys.ts, keys.seq, start(df), *names), allowMissingColumns=True)
    order = F.struct(keys.ts, keys.seq)
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns]
    each = both.groupBy(keys.symbol, "_start").agg(F.avg("_price").alias("avg_trade_price"), F.sum("_size").alias("total_trade_volume"), *last).withColumnRenamed("_start", keys.ts)
    return filled(dense(each, every, keys=keys), ["avg_trade_price", *columns], method, keys)


def trade_features(trades: DataFrame, every: int, keys: Keys = KEYS) -> DataFrame:
    """Dense buckets of signed trades (price, size, side): counts and sums are 0 in empty buckets, means null."""
    size, side = F.col("size"), F.col("side")
    sums = aggregated(trades, every, {
        "trade_count": F.count("*"), "mean_side": F.avg("side"), "buys": F.sum((side > 0).cast("long")), "sells": F.sum((side < 0).cast("long")), "total_size": F.sum("size"),
        "buy_volume": F.sum(F.when(side > 0, size).otherwise(0)), "sell_volume": F.sum(F.when(side < 0, size).otherwise(0)), "signed_size": F.sum(size * side),
    }, keys)
    counts = ["trade_count", "buys", "sells", "total_size", "buy_volume", "sell_volume", "signed_size"]
    b, s = F.col("buy_volume"), F.col("sell_volume")
    return dense(sums, every, counts, keys).withColumns({"volume_imbalance": divide((b - s).cast("double"), (b + s).cast("double")), "avg_trade_size": divide(F.col("total_size").cast("double"), F.col("trade_count").cast("double"))})
