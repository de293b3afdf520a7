"""The test tables seen as market data, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resample import ohlc

LEVELS = 3
HOUR, DAY = 3600, 86_400


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _events(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").where(F.col("event_type").isin(*kinds))
    return rows.select(F.col("user_id").alias("symbol"), "ts", F.col("event_id").alias("seq"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and clicks: price is the value, size the number in props plus 1."""
    return _events(spark, sf_dir, "purchase", "click").select("symbol", "ts", "seq", F.col("value").alias("price"), (F.col("k") + 1).alias("size"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and signups: a spread around the value."""
    v, k = F.col("value"), F.col("k")
    return _events(spark, sf_dir, "view", "signup").select("symbol", "ts", "seq", (v * 0.999).alias("bid_price"), (v * 1.001).alias("ask_price"), (k + 1).alias("bid_size"), (100 - k).alias("ask_size"))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors: a book's mid price and depth."""
    return _events(spark, sf_dir, "error").select("symbol", "ts", "seq", F.col("value").alias("mid"), F.col("k").alias("depth"))


def bars(spark: SparkSession, sf_dir: str, every: int = DAY) -> DataFrame:
    return ohlc(trades(spark, sf_dir), every)


def ordered_bars(spark: SparkSession, sf_dir: str, every: int = DAY) -> DataFrame:
    return bars(spark, sf_dir, every).withColumn("seq", F.lit(0).cast("long"))


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of three lines or more as wide snapshots: a line is a level."""
    from pyspark.sql import Window

    level = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", level.alias("level"))
    cell = lambda x, i: F.max(F.when(F.col("level") == i, x))
    made = {}
    for i in range(1, LEVELS + 1):
        made |= {f"bid_price_{i}": cell(100 - 0.01 * F.col("level"), i), f"bid_volume_{i}": cell(F.col("l_quantity"), i), f"ask_price_{i}": cell(100 + 0.01 * F.col("level") + F.col("l_discount"), i), f"ask_volume_{i}": cell(F.col("l_extendedprice") / 1000, i)}
    return lines.groupBy(F.col("l_orderkey").alias("book")).agg(F.count("*").alias("_n"), *[c.alias(n) for n, c in made.items()]).where(F.col("_n") >= LEVELS).drop("_n")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as predictions: label by value, probability by the number in props, return by both, regime by event type."""
    rows = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    regime = F.when(F.col("event_type").isin("error", "signup"), "Volatile").when(F.col("event_type") == "view", "Trending").otherwise("Calm")
    return rows.select(
        F.col("user_id").alias("symbol"), "ts", F.col("event_id").alias("seq"), (F.col("value") > 50).cast("int").alias("label"), ((F.col("k") + 0.5) / 100).alias("probability"),
        (F.col("k") >= 50).cast("int").alias("prediction"), ((F.col("k") % 7 - 3) / 1000.0).alias("return"), regime.alias("regime"), (F.col("k") % 3 != 0).cast("int").alias("other"),
    )


TRADES = "trades AS (SELECT user_id AS symbol, ts, event_id AS seq, value AS price, CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS size FROM events WHERE event_type IN ('purchase', 'click'))"
QUOTES = """quotes AS (SELECT user_id AS symbol, ts, event_id AS seq, value * 0.999 AS bid_price, value * 1.001 AS ask_price, CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS bid_size,
 100 - CAST(json_extract(props, '$.k') AS BIGINT) AS ask_size FROM events WHERE event_type IN ('view', 'signup'))"""


def bars_sql(unit: str = "day") -> str:
    return f"""{TRADES}, bars AS (SELECT symbol, date_trunc('{unit}', ts)::TIMESTAMP AS ts, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close,
 CAST(sum(size) AS BIGINT) AS volume, sum(price * size) / sum(size) AS vwap, count(*) AS trades FROM trades GROUP BY ALL)"""


BOOK = """lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS level FROM lineitem),
book AS (SELECT l_orderkey AS book, """ + ", ".join(
    f"max(CASE WHEN level = {i} THEN 100 - 0.01::DOUBLE * level END) AS bid_price_{i}, max(CASE WHEN level = {i} THEN l_quantity END) AS bid_volume_{i}, max(CASE WHEN level = {i} THEN 100 + 0.01::DOUBLE * level + l_discount END) AS ask_price_{i}, max(CASE WHEN level = {i} THEN l_extendedprice / 1000 END) AS ask_volume_{i}"
    for i in range(1, LEVELS + 1)
) + f" FROM lines GROUP BY l_orderkey HAVING count(*) >= {LEVELS})"
PREDICTIONS = """raw AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
predictions AS (SELECT user_id AS symbol, ts, event_id AS seq, CAST(value > 50 AS INT) AS label, (k + 0.5::DOUBLE) / 100 AS probability, CAST(k >= 50 AS INT) AS prediction, (k % 7 - 3) / 1000.0::DOUBLE AS "return",
 CASE WHEN event_type IN ('error', 'signup') THEN 'Volatile' WHEN event_type = 'view' THEN 'Trending' ELSE 'Calm' END AS regime, CAST(k % 3 <> 0 AS INT) AS other FROM raw)"""
