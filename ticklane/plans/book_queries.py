"""Queries on order-book snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import book as B
from ..operators import filters
from . import tables as T
from .registry import near, query, rounded, rounded_sql

N = T.LEVELS
plus = lambda side, n=N: "(" + " + ".join(f"{side}_volume_{i}" for i in range(1, n + 1)) + ")"
ratio = lambda b, a: f"(({b}) - ({a})) / (({b}) + ({a}) + 1e-10)"
side_vwap = lambda s: "(" + " + ".join(f"{s}_price_{i} * {s}_volume_{i}" for i in range(1, N + 1)) + f") / ({plus(s)} + 1e-10)"
decayed = lambda s: " + ".join(f"{s}_volume_{i} * 0.8::DOUBLE ** {i}" for i in range(1, N + 1))


def registered(name: str, columns: dict, sql: dict[str, str]):
    """A query of row expressions over the book."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return T.book(spark, sf).select("book", *rounded(columns()))

    run.__name__ = name
    query(f"WITH {T.BOOK} SELECT book, {rounded_sql(sql)} FROM book")(run)


registered("book_spreads", lambda: {"mid": B.mid(), "spread": B.spread(), "relative": B.relative_spread(), "bps": B.relative_spread(scale=1e4), "level_2": B.level_spread(2), "average": B.average_spread(N), "effective": B.effective_spread(N), "weighted_mid": B.weighted_mid()}, {
    "mid": "(bid_price_1 + ask_price_1) / 2", "spread": "ask_price_1 - bid_price_1", "relative": "(ask_price_1 - bid_price_1) / ((bid_price_1 + ask_price_1) / 2)", "bps": "(ask_price_1 - bid_price_1) / ((bid_price_1 + ask_price_1) / 2) * 1e4::DOUBLE", "level_2": "ask_price_2 - bid_price_2",
    "average": "((ask_price_1 - bid_price_1) + (ask_price_2 - bid_price_2) + (ask_price_3 - bid_price_3)) / 3", "effective": f"{side_vwap('ask')} - {side_vwap('bid')}", "weighted_mid": "(bid_price_1 * ask_volume_1 + ask_price_1 * bid_volume_1) / (bid_volume_1 + ask_volume_1 + 1e-10)"})
registered("book_imbalance", lambda: {"standard": B.level_imbalance(1), "ratio": B.imbalance("bid_volume_1", "ask_volume_1", "ratio"), "log_ratio": B.imbalance("bid_volume_1", "ask_volume_1", "log_ratio"), "levels": B.multi_level_imbalance(N), "decayed": B.decayed_imbalance(N), "gradient": B.imbalance_gradient(1, N), "difference": B.volume_difference(N), "normalised": B.volume_difference(N, True)}, {
    "standard": ratio("bid_volume_1", "ask_volume_1"), "ratio": "bid_volume_1 / (ask_volume_1 + 1e-10)", "log_ratio": "ln(bid_volume_1 / (ask_volume_1 + 1e-10))", "levels": ratio(plus("bid"), plus("ask")), "decayed": ratio(decayed("bid"), decayed("ask")),
    "gradient": f"{ratio('bid_volume_1', 'ask_volume_1')} - {ratio('bid_volume_3', 'ask_volume_3')}", "difference": f"{plus('bid')} - {plus('ask')}", "normalised": ratio(plus("bid"), plus("ask"))})
registered("book_depth", lambda: {"bid_depth_2": B.depth("bid", 2), "ask_depth_3": B.depth("ask", N), "ratio": B.depth_ratio(N), "thickness": B.thickness(N), "thickness_ratio": B.thickness_ratio(N), "concentration": B.concentration(1, N), "asymmetry": B.concentration_asymmetry(1, N)}, {
    "bid_depth_2": plus("bid", 2), "ask_depth_3": plus("ask"), "ratio": f"{plus('bid')} / ({plus('ask')} + 1e-10)", "thickness": f"({plus('bid')} / 3 + {plus('ask')} / 3) / 2", "thickness_ratio": f"({plus('bid')} / 3) / ({plus('ask')} / 3 + 1e-10)",
    "concentration": f"(bid_volume_1 / ({plus('bid')} + 1e-10) + ask_volume_1 / ({plus('ask')} + 1e-10)) / 2", "asymmetry": f"bid_volume_1 / ({plus('bid')} + 1e-10) - ask_volume_1 / ({plus('ask')} + 1e-10)"})


@query(f"WITH {T.BOOK}, l AS (SELECT book, unnest([bid_price_1, bid_price_2, bid_price_3]) AS p, unnest([bid_volume_1, bid_volume_2, bid_volume_3]) AS v, bid_price_1 AS b FROM book) SELECT book, round(-regr_slope(ln(v + 1), abs(p - b)) + 3.1e-05::DOUBLE, 3) AS slope FROM l GROUP BY book")
def book_slope(spark: SparkSession, sf: str) -> DataFrame:
    return T.book(spark, sf).select("book", *rounded({"slope": B.slope("bid", N)}, 3))


@query(f"WITH {T.BOOK}, a AS (SELECT book, bid_price_1 AS b1, bid_price_2 - bid_volume_2 / 1000 + 0.03::DOUBLE AS b2 FROM book) SELECT book, round(CASE WHEN b1 - b2 > 0 THEN b2 END + 3.1e-08::DOUBLE, 6) AS bid_price_2 FROM a")
def book_ordered_levels(spark: SparkSession, sf: str) -> DataFrame:
    crossed = T.book(spark, sf).withColumn("bid_price_2", F.col("bid_price_2") - F.col("bid_volume_2") / 1000 + 0.03)
    return filters.ordered_levels(crossed, 2).select("book", near("bid_price_2").alias("bid_price_2"))


_FEATURES = {
    "mid_price": "(bid_price_1 + ask_price_1) / 2", "quoted_spread": "ask_price_1 - bid_price_1", "relative_spread": "(ask_price_1 - bid_price_1) / ((bid_price_1 + ask_price_1) / 2)", "depth_at_best": "bid_volume_1 + ask_volume_1",
    "depth_imbalance": "(bid_volume_1 - ask_volume_1) / nullif(bid_volume_1 + ask_volume_1, 0)", "cumulative_bid_depth_2": "bid_volume_1 + bid_volume_2", "cumulative_ask_depth_2": "ask_volume_1 + ask_volume_2",
    "cumulative_depth_2": "bid_volume_1 + bid_volume_2 + ask_volume_1 + ask_volume_2", "concentration_1": "(bid_volume_1 / (bid_volume_1 + bid_volume_2 + bid_volume_3 + 1e-10::DOUBLE) + ask_volume_1 / (ask_volume_1 + ask_volume_2 + ask_volume_3 + 1e-10::DOUBLE)) / 2",
}


@query(f"WITH {T.BOOK} SELECT book, {rounded_sql(_FEATURES, 4)} FROM book")
def book_features(spark: SparkSession, sf: str) -> DataFrame:
    made = B.book_features(N, (2, 5)) | B.concentrations((1,), N)
    return T.book(spark, sf).withColumns(made).select("book", *rounded({c: F.col(c) for c in _FEATURES}, 4))
