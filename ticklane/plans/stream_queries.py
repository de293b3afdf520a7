"""Queries on recorded depth feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..streaming import books
from . import tables as T
from .registry import query

# Lines as a feed: a supplier is a symbol, its lines in order are depth updates 400 ms apart; every 37th is lost, and a book is fetched at every 50th id from 1.
_FEED = """feed AS (SELECT l_suppkey AS symbol, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS id, l_linenumber AS n, l_quantity AS q, l_partkey AS k FROM lineitem)"""


def depth_feed(spark: SparkSession, sf: str) -> DataFrame:
    lines = T.read(spark, sf, "lineitem")
    at = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey"))
    feed = lines.select(F.col("l_suppkey").cast("string").alias("symbol"), at.cast("long").alias("last_id"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"), F.col("l_partkey").alias("k"))
    level = lambda price, size: F.array(F.array(price.cast("string"), size.cast("string")))
    feed = feed.withColumns({"first_id": F.col("last_id"), "event_ms": F.col("last_id") * 400})
    updates = feed.where("last_id % 37 != 0").select("symbol", "first_id", "last_id", F.when(F.col("last_id") % 2 == 0, F.col("last_id") - 1).alias("previous_id"), level(100 - F.col("n"), F.when(F.col("q") % 5 == 0, 0).otherwise(F.col("q"))).alias("bids"), level(101 + F.col("k") % 10, F.when(F.col("k") % 3 == 0, 0).otherwise(F.col("k"))).alias("asks"), "event_ms")
    fetched = feed.where("last_id % 50 = 1").select("symbol", "last_id", F.expr("array(array('99', '1'), array('98', '2'))").alias("bids"), F.expr("array(array('105', '1'))").alias("asks"), "event_ms")
    return books.events(updates, fetched)


@query(f"""WITH {_FEED}, alive AS (
  SELECT *, ((id - 2) // 50) * 50 + 1 AS epoch, id * 400 // 1000 AS second FROM feed WHERE id >= 2 AND id // 37 = (((id - 2) // 50) * 50 + 1) // 37
), changes AS (
  SELECT symbol, epoch, id, 'bids' AS side, 100 - n AS price, CASE WHEN q % 5 = 0 THEN 0 ELSE q END::DOUBLE AS size FROM alive
  UNION ALL SELECT symbol, epoch, id, 'asks', 101 + k % 10, CASE WHEN k % 3 = 0 THEN 0 ELSE k END FROM alive
  UNION ALL SELECT DISTINCT symbol, epoch, epoch, x.side, x.price, x.size FROM alive, (VALUES ('bids', 99, 1), ('bids', 98, 2), ('asks', 105, 1)) x(side, price, size)
), shown AS (SELECT symbol, epoch, second, max(id) AS last FROM alive GROUP BY ALL
), sizes AS (
  SELECT s.symbol, s.epoch, s.second, side, price, arg_max(size, id) AS size FROM shown s JOIN changes c ON c.symbol = s.symbol AND c.epoch = s.epoch AND c.id <= s.last GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, epoch, second, side ORDER BY CASE side WHEN 'bids' THEN -price ELSE price END) AS level FROM sizes WHERE size > 0
)
SELECT symbol::VARCHAR AS symbol, second, side, level::INTEGER AS level, price::DOUBLE AS price, size FROM ranked WHERE level <= 3""")
def recovered_books(spark: SparkSession, sf: str) -> DataFrame:
    made = books.recorded(depth_feed(spark, sf), 3, 120)
    sides = [made.select("symbol", "second", F.lit(s).alias("side"), F.posexplode(s).alias("level", "x")) for s in books.SIDES]
    return sides[0].union(sides[1]).select("symbol", "second", "side", (F.col("level") + 1).alias("level"), F.get("x", F.lit(0)).alias("price"), F.get("x", F.lit(1)).alias("size"))
