"""Trades, quotes, bars and order books from Parquet: declared schemas, ranges of time pushed to the scan, and the usual clean-up; and sinks partitioned by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import book as B
from ..operators import filters, micro, quality, resample

SCHEMAS = {
    "trades": "symbol string, ts timestamp_ntz, seq long, price double, size long, exchange int, conditions array<int>",
    "quotes": "symbol string, ts timestamp_ntz, seq long, bid_price double, bid_size long, ask_price double, ask_size long, bid_exchange int, ask_exchange int",
    "bars": "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, vwap double, trades long",
}


def read_rows(spark: SparkSession, path: str | list[str], kind: str | None = None, start: str | None = None, end: str | None = None, ts: str = "ts", skip_corrupt: bool = False) -> DataFrame:
    """Rows from start to end, both included; a date as end means its midnight. kind: a name in SCHEMAS, else the files' own schema. Corrupt files fail the read unless they are skipped by wish."""
    reader = spark.read.option("ignoreCorruptFiles", str(skip_corrupt).lower())
    rows = (reader.schema(SCHEMAS[kind]) if kind else reader).parquet(*([path] if isinstance(path, str) else path))
    if start is not None:
        rows = rows.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        rows = rows.where(F.col(ts) <= F.lit(end).cast("timestamp_ntz"))
    return filters.normalised_missing(rows)


def trades(spark: SparkSession, path: str | list[str], start: str | None = None, end: str | None = None, regular: bool = True, quotes: DataFrame | None = None) -> DataFrame:
    """Trades, without irregular conditions, and classified if quotes are given."""
    rows = read_rows(spark, path, "trades", start, end)
    rows = filters.regular_trades(rows) if regular else rows
    return rows if quotes is None else micro.classify(rows, quotes)


def quotes(spark: SparkSession, path: str | list[str], start: str | None = None, end: str | None = None, valid: bool = True, features: bool = True, every: int | None = None) -> DataFrame:
    """Quotes, the valid ones, with their features, or the last of each bucket of `every` seconds."""
    rows = read_rows(spark, path, "quotes", start, end)
    rows = filters.valid_quotes(rows) if valid else rows
    rows = rows.withColumns(B.nbbo()) if features else rows
    return rows if every is None else resample.last_values(rows, every, [c for c in rows.columns if c not in ("symbol", "ts", "seq")])


def bars(spark: SparkSession, path: str | list[str], start: str | None = None, end: str | None = None, features: bool = True) -> DataFrame:
    rows = read_rows(spark, path, "bars", start, end)
    return rows.withColumns(B.bar_features()) if features else rows


def book(spark: SparkSession, path: str | list[str], levels: int = 10, start: str | None = None, end: str | None = None, zero_indexed: bool = False, nested: bool = False, ordered: bool = True) -> DataFrame:
    """Snapshots with columns bid_price_1 and so on. zero_indexed: the files count levels from 0; nested: they hold arrays of [price, volume]; ordered: levels out of order become null."""
    rows = read_rows(spark, path, None, start, end)
    rows = filters.levels_from_arrays(rows, levels) if nested else rows
    rows = filters.zero_indexed_levels(rows, by=1) if zero_indexed else rows
    return filters.ordered_levels(rows, levels) if ordered else rows


def epoch(column: Column | str, unit: str = "ns") -> Column:
    """A number of ns, us, ms or s since 1970 as a timestamp; nanoseconds are cut to microseconds."""
    c = (F.col(column) if isinstance(column, str) else column).cast("long")
    made = {"ns": lambda: F.timestamp_micros(F.call_function("div", c - F.pmod(c, F.lit(1000)), F.lit(1000))), "us": lambda: F.timestamp_micros(c), "ms": lambda: F.timestamp_millis(c), "s": lambda: F.timestamp_seconds(c)}
    return made[unit]().cast("timestamp_ntz")


def standard_bars(rows: DataFrame) -> DataFrame:
    """Rows with the short names t (ms), o, h, l, c, v, vw, n as bars."""
    number = lambda c: F.col(c).try_cast("double")
    names = {"o": "open", "h": "high", "l": "low", "c": "close", "v": "volume", "vw": "vwap"}
    return rows.select("symbol", epoch("t", "ms").alias("ts"), *[number(a).alias(b) for a, b in names.items()], F.col("n").try_cast("long").alias("trades"))


def standard_ticks(rows: DataFrame, times: tuple[str, ...] = ("sip_timestamp", "participant_timestamp")) -> DataFrame:
    """Rows with ts from the first of the ns columns that is there and not null."""
    found = [F.col(c) for c in times if c in rows.columns]
    if not found:
        raise ValueError(f"none of {times} is a column")
    return rows.withColumn("ts", epoch(F.coalesce(*found)))


def cleaned(rows: DataFrame, columns: list[str], threshold: float = 3.0) -> DataFrame:
    """Complete rows inside the given IQR bounds."""
    return quality.without_outliers(rows.na.drop(), columns, "iqr", threshold)


def days(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(day) from start to end, both included."""
    return spark.sql("select explode(sequence(cast(:a as date), cast(:b as date))) as day", args={"a": start, "b": end})


def write_days(rows: DataFrame, path: str, mode: str = "append", ts: str = "ts", symbol: str = "symbol") -> None:
    """Parquet partitioned by day, each file sorted by symbol and time, so that statistics of its row groups tell which symbols are where: the number of files goes by days and bytes, not by symbols. Large days are split by Spark."""
    dated = rows.withColumn("day", F.to_date(ts))
    dated.hint("rebalance", "day").sortWithinPartitions("day", symbol, ts).write.mode(mode).partitionBy("day").parquet(path)
