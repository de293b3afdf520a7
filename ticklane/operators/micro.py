"""Trade classification and order flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import quotient
from .asof import asof_join
from .keys import KEYS, Keys


def quote_side(price: Column, mid: Column) -> Column:
    """1 above the mid price, -1 below, else (and without a quote) 0."""
    return F.when(price > mid, 1).when(price < mid, -1).otherwise(0)


def classify(trades: DataFrame, quotes: DataFrame, tolerance: float | None = None, keys: Keys = KEYS, bucket: str | None = None) -> DataFrame:
    """Trades with bid_price, ask_price, mid_price of the last quote, side by the quote rule, and flags of aggressive buys and sells. bucket: see asof_join."""
    joined = asof_join(trades, quotes.select(keys.symbol, keys.ts, keys.seq, "bid_price", "ask_price"), tolerance, keys=keys, bucket=bucket)
    mid = (F.col("bid_price") + F.col("ask_price")) / 2
    sided = joined.drop(f"{keys.ts}_right", f"{keys.seq}_right").withColumns({"mid_price": mid, "side": quote_side(F.col("price"), mid)})
    return sided.withColumns({"is_aggressive_buy": F.col("side") == 1, "is_aggressive_sell": F.col("side") == -1})


def tick_side(price: str = "price", mid: str = "mid_price", keys: Keys = KEYS) -> Column:
    """Quote rule; at the mid the direction against the trade before, 0 without change."""
    before = F.lag(price).over(keys.ordered())
    by_tick = F.coalesce(F.signum(F.col(price) - before).cast("int"), F.lit(0))
    return F.when(F.col(price) > F.col(mid), 1).when(F.col(price) < F.col(mid), -1).when(F.col(mid).isNull(), 0).otherwise(by_tick)


def signed_sizes(side: str = "side", size: str = "size") -> dict[str, Column]:
    s, n = F.col(side), F.col(size)
    return {"signed_size": n * s, "buy_volume": F.when(s > 0, n).otherwise(0), "sell_volume": F.when(s < 0, n).otherwise(0)}


def price_impact(price: str = "price", mid: str = "mid_price", size: str = "size", ahead: int = 5, keys: Keys = KEYS) -> dict[str, Column]:
    """Temporary impact against the mid price, permanent impact `ahead` trades later (looks ahead), and temporary impact by log size."""
    p, m = F.col(price), F.col(mid)
    temporary = quotient(p - m, m)
    return {"temporary_impact": temporary, "permanent_impact": quotient(F.lead(price, ahead).over(keys.ordered()) - p, p), "impact_per_share": quotient(temporary, F.ln(1 + F.col(size)))}


def next_move(mid: str = "mid_price", keys: Keys = KEYS) -> Column:
    """1 if the next mid price is higher, else 0; null on the last row."""
    following = F.lead(mid).over(keys.ordered())
    return F.when(following.isNotNull() & F.col(mid).isNotNull(), (following > F.col(mid)).cast("int"))


def side_of_maker(buyer_is_maker: str = "is_buyer_maker") -> Column:
    """The aggressor's side from the maker flag: a buyer who made the market was sold to."""
    return F.when(F.col(buyer_is_maker), "sell").when(~F.col(buyer_is_maker), "buy")
