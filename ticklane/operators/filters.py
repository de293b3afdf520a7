"""Row and column filters, renaming and reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import seconds_between
from .keys import KEYS, Keys

#: Codes of trade conditions that mark a trade as irregular.
IRREGULAR_CONDITIONS = (4, 6, 7, 9, 14, 15, 16, 37, 38, 52, 53, 54, 55, 56)


def regular_trades(trades: DataFrame, conditions: str = "conditions", codes: tuple[int, ...] = IRREGULAR_CONDITIONS) -> DataFrame:
    """Trades without any of the codes; null and empty conditions are regular. Conditions may be an array or one number."""
    c = F.col(conditions)
    found = F.arrays_overlap(c, F.array(*map(F.lit, codes))) if isinstance(trades.schema[conditions].dataType, T.ArrayType) else c.isin(*codes)
    return trades.where(~F.coalesce(found, F.lit(False)))


def valid_quotes(quotes: DataFrame) -> DataFrame:
    """Quotes with positive prices and sizes whose ask is above the bid."""
    return quotes.where("ask_price > bid_price and bid_price > 0 and ask_price > 0 and bid_size > 0 and ask_size > 0")


def with_staleness(quotes: DataFrame, most: float = 1.0, keys: Keys = KEYS) -> DataFrame:
    gap = seconds_between(F.lag(keys.ts).over(keys.ordered()), keys.ts)
    return quotes.withColumn("time_since_last_update", gap).withColumn("is_stale", F.coalesce(F.col("time_since_last_update") > most, F.lit(False)))


def within_gap(rows: DataFrame, most: float, keys: Keys = KEYS) -> DataFrame:
    """Rows at most `most` seconds after the row before, and first rows."""
    gap = seconds_between(F.lag(keys.ts).over(keys.ordered()), keys.ts)
    return rows.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") <= most)).drop("_gap")


def confident(predictions: DataFrame, least: float = 0.6, probability: str = "probability") -> DataFrame:
    """Predictions with confidence 2|p - 0.5| of at least `least`."""
    return predictions.withColumn("confidence", 2 * F.abs(F.col(probability) - 0.5)).where(F.col("confidence") >= least)


def after_warm_up(rows: DataFrame, minutes: str = "minutes_since_open", least: int = 30) -> DataFrame:
    return rows.where(F.col(minutes) >= least)


def zero_indexed_levels(book: DataFrame, parts: tuple[str, ...] = ("bid_price", "bid_volume", "ask_price", "ask_volume"), by: int = -1) -> DataFrame:
    """Level columns part_i renamed to part_{i + by}."""
    levels = {c: f"{p}_{int(c[len(p) + 1 :]) + by}" for p in parts for c in book.columns if c.startswith(f"{p}_") and c[len(p) + 1 :].isdigit()}
    return book.select(*[F.col(c).alias(levels.get(c, c)) for c in book.columns])


def levels_from_arrays(book: DataFrame, n: int, bids: str = "bids", asks: str = "asks") -> DataFrame:
    """Arrays of [price, volume] as wide columns with levels from 1; null where an array is short."""
    cell = lambda side, i, k: F.get(F.get(side, F.lit(i)), F.lit(k))
    wide = {f"{name}_{part}_{i + 1}": cell(side, i, k) for name, side in (("bid", bids), ("ask", asks)) for i in range(n) for k, part in enumerate(("price", "volume"))}
    return book.withColumns(wide).drop(bids, asks)


def ordered_levels(book: DataFrame, n: int) -> DataFrame:
    """Nulls a level whose price does not lie beyond the level before; a nulled level leaves the next one unchecked."""
    for side, sign in (("bid", 1), ("ask", -1)):
        for i in range(1, n):
            here, nxt = F.col(f"{side}_price_{i}"), F.col(f"{side}_price_{i + 1}")
            bad = F.coalesce(sign * (here - nxt) <= 0, F.lit(False))
            book = book.withColumns({f"{side}_{p}_{i + 1}": F.when(~bad, F.col(f"{side}_{p}_{i + 1}")) for p in ("price", "volume")})
    return book


def feature_groups(columns: list[str]) -> dict[str, list[str]]:
    """Column names by the words they hold; a name may be in several groups."""
    words = ("price", "spread", "return", "imbalance", "depth", "queue", "vol", "thick", "time")
    return {w: [c for c in columns if w in c.lower()] for w in words}


def numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def finite(x: Column) -> Column:
    """x, null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def normalised_missing(df: DataFrame) -> DataFrame:
    """df with NaN and infinities of floating columns as null."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: finite(F.col(c)) for c in floats}) if floats else df


def important(df: DataFrame, importance: DataFrame, columns: list[str], least: float = 0.01, name: str = "feature", value: str = "importance") -> DataFrame:
    """df without those of the columns whose importance is less or unknown; the table of importances, a row per feature, is taken to the driver."""
    kept = {r[0] for r in importance.where(F.col(value) >= least).select(name).collect()}
    return df.drop(*[c for c in columns if c not in kept])


def cleaned(df: DataFrame, columns: list[str], threshold: float = 3.0) -> DataFrame:
    """Complete rows inside threshold times the interquartile range of each column."""
    from .quality import without_outliers

    return without_outliers(df.dropna(), columns, "iqr", threshold)


def filled(df: DataFrame, columns: list[str], keys: Keys = KEYS) -> DataFrame:
    """df with missing, NaN and infinite values of columns filled from the last known, else the next known one, else 0."""
    ahead = keys.ordered().rowsBetween(0, Window.unboundedFollowing)
    whole = df.withColumns({c: finite(F.col(c).cast("double")) for c in columns})
    return whole.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(keys.so_far()), F.first(c, ignorenulls=True).over(ahead), F.lit(0.0)) for c in columns})
