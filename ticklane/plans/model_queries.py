"""Queries on fitted models: Hawkes windows, hidden regimes, components, classifiers, streamed bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hawkes, hmm, models, reduction, rolling
from ..operators.lineage import materialised
from ..streaming import flows
from . import tables as T
from .registry import query

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query()
def hawkes_windows(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.read(spark, sf, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"))
    made = hawkes.rolling_fit(rows)
    return made.withColumns({"regime": hawkes.regime_label(), "is_burst": hawkes.bursts()})


@query()
def hidden_regimes(spark: SparkSession, sf: str) -> DataFrame:
    bars = T.ordered_bars(spark, sf).where("high > 0 and low > 0").withColumns({"range": F.ln(F.col("high") / F.col("low")), "ret": F.abs(rolling.log_return("close"))})
    return hmm.decode(bars, hmm.fit(bars, ["range", "ret"]))


@query()
def principal_components(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.read(spark, sf, "lineitem")
    return reduction.fit(rows, FEATURES, 0.9).transform(rows).select("l_orderkey", "l_linenumber", "pc_1", "pc_2")


@query()
def forest_predictions(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.bars(spark, sf).withColumns({"range": F.col("high") - F.col("low"), "move": F.col("close") - F.col("open")})
    rows = rows.withColumn("label", (F.lead("close").over(rolling.Window.partitionBy("symbol").orderBy("ts")) > F.col("close")).cast("int")).dropna()
    rows = materialised(rows)  # read by the cut, the class sizes, the fit and the scores
    early, late = models.temporal_split(rows)
    model = models.train(early, ["range", "move", "volume", "vwap"], "forest")
    return models.predict(model, late).select("symbol", "ts", "label", "prediction", "probability")


@query(f"WITH {T.bars_sql('hour')} SELECT symbol, ts, open, high, low, close, volume, trades FROM bars")
def windowed_bars(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming bars over a stored table."""
    return flows.bars(T.trades(spark, sf), "1 hour").drop("vwap").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("WITH c AS (SELECT l_suppkey AS symbol, CASE WHEN l_linenumber % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, l_discount AS price, arg_max(CASE WHEN l_quantity > 10 THEN l_quantity ELSE 0 END, (l_orderkey, l_linenumber, l_partkey)) AS size FROM lineitem GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) AS INT) AS level FROM c WHERE size > 0) SELECT symbol, side, level, price, size FROM r WHERE level <= 5")
def book_from_changes(spark: SparkSession, sf: str) -> DataFrame:
    side = F.when(F.col("l_linenumber") % 2 == 0, "bid").otherwise("ask")
    rows = T.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("symbol"), side.alias("side"), F.col("l_discount").alias("price"), F.when(F.col("l_quantity") > 10, F.col("l_quantity")).otherwise(0).alias("size"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("seq"))
    return flows.book_at(rows, 5)
