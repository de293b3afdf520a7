"""Queries that write the test tables as feeds and read them back, and models on fixed parameters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import quotient
from ..operators import hawkes, hmm, micro
from ..operators.lineage import new_path
from ..sources import readers
from . import tables as T
from .registry import near, near_sql, query, rounded, rounded_sql

START, END = "2024-01-01", "2024-02-15"
_BETWEEN = f"ts >= TIMESTAMP '{START}' AND ts <= TIMESTAMP '{END}'"


def _stored(rows: DataFrame) -> str:
    """rows written by symbol and day."""
    path = new_path(rows.sparkSession)
    readers.write_days(rows.withColumn("symbol", F.col("symbol").cast("string")), path)
    return path


def _trade_feed(spark: SparkSession, sf: str) -> DataFrame:
    codes = F.when(F.col("size") % 5 == 0, F.array(F.lit(12), F.lit(37))).when(F.col("size") % 5 == 1, F.array(F.lit(12))).when(F.col("size") % 5 == 2, F.array().cast("array<int>"))
    price = F.when(F.col("size") % 7 == 0, float("nan")).otherwise(F.col("price"))
    return T.trades(spark, sf).withColumns({"price": price, "exchange": (F.col("size") % 4).cast("int"), "conditions": codes})


@query(f"WITH {T.TRADES} SELECT symbol::VARCHAR AS symbol, ts, seq, CASE WHEN size % 7 <> 0 THEN price END AS price, size FROM trades WHERE size % 5 <> 0 AND {_BETWEEN}")
def stored_trades(spark: SparkSession, sf: str) -> DataFrame:
    """Regular trades of a range of time; prices that are no numbers become null."""
    return readers.trades(spark, _stored(_trade_feed(spark, sf)), START, END).select("symbol", "ts", "seq", "price", "size")


@query(f"WITH {T.TRADES}, {T.QUOTES} SELECT t.symbol::VARCHAR AS symbol, t.ts, t.seq, CASE WHEN t.price > (q.bid_price + q.ask_price) / 2 THEN 1 WHEN t.price < (q.bid_price + q.ask_price) / 2 THEN -1 ELSE 0 END AS side FROM trades t ASOF LEFT JOIN quotes q ON t.symbol = q.symbol AND t.ts >= q.ts")
def stored_trades_classified(spark: SparkSession, sf: str) -> DataFrame:
    """All stored trades against stored quotes, symbols split by day in the as-of join."""
    trades = readers.trades(spark, _stored(T.trades(spark, sf).withColumns({"exchange": F.lit(1), "conditions": F.array().cast("array<int>")})), regular=False)
    quotes = readers.quotes(spark, _stored(_quote_feed(spark, sf)), valid=False, features=False)
    return micro.classify(trades, quotes, bucket="day").select("symbol", "ts", "seq", "side")


def _quote_feed(spark: SparkSession, sf: str) -> DataFrame:
    return T.quotes(spark, sf).withColumns({"bid_exchange": F.lit(1), "ask_exchange": F.lit(2)})


@query(f"WITH {T.QUOTES} SELECT symbol::VARCHAR AS symbol, ts, seq, {rounded_sql({'mid_price': '(bid_price + ask_price) / 2', 'spread_bps': '(ask_price - bid_price) / ((bid_price + ask_price) / 2) * 1e4'}, 5)}, {near_sql('(bid_size - ask_size) / (bid_size + ask_size)')} AS order_flow_imbalance FROM quotes WHERE ask_price > bid_price AND bid_price > 0 AND bid_size > 0 AND ask_size > 0 AND {_BETWEEN}")
def stored_quotes(spark: SparkSession, sf: str) -> DataFrame:
    made = readers.quotes(spark, _stored(_quote_feed(spark, sf)), START, END)
    return made.select("symbol", "ts", "seq", *rounded({c: F.col(c) for c in ("mid_price", "spread_bps")}, 5), near("order_flow_imbalance").alias("order_flow_imbalance"))


@query(f"WITH {T.QUOTES} SELECT symbol::VARCHAR AS symbol, date_trunc('day', ts)::TIMESTAMP AS ts, {near_sql('arg_max(bid_price, (ts, seq))')} AS bid_price, arg_max(ask_size, (ts, seq)) AS ask_size FROM quotes WHERE ask_price > bid_price AND bid_price > 0 AND bid_size > 0 AND ask_size > 0 GROUP BY ALL")
def stored_quotes_daily(spark: SparkSession, sf: str) -> DataFrame:
    return readers.quotes(spark, _stored(_quote_feed(spark, sf)), features=False, every=T.DAY).select("symbol", "ts", near("bid_price").alias("bid_price"), "ask_size")


@query(f"WITH {T.bars_sql()} SELECT symbol::VARCHAR AS symbol, ts, {rounded_sql({'close': 'close', 'price_range': '(high - low) / close', 'vwap_deviation': '(close - vwap) / vwap'}, 5)}, trades FROM bars WHERE {_BETWEEN}")
def stored_bars(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.bars(spark, sf).withColumn("volume", F.col("volume").cast("double"))
    made = readers.bars(spark, _stored(rows), START, END)
    return made.select("symbol", "ts", *rounded({"close": F.col("close"), "price_range": quotient(F.col("high") - F.col("low"), F.col("close")), "vwap_deviation": quotient(F.col("close") - F.col("vwap"), F.col("vwap"))}, 5), "trades")


_LEVELS = [f"{s}_{p}_{i}" for i in range(1, T.LEVELS + 1) for s in ("bid", "ask") for p in ("price", "volume")]


@query(f"WITH {T.BOOK} SELECT book, {rounded_sql({c: c for c in _LEVELS}, 5)} FROM book")
def stored_nested_books(spark: SparkSession, sf: str) -> DataFrame:
    """Books as arrays of [price, volume], written and read as wide snapshots."""
    pair = lambda s, i: F.array(F.col(f"{s}_price_{i}"), F.col(f"{s}_volume_{i}"))
    nested = T.book(spark, sf).select("book", *[F.array(*[pair(s, i) for i in range(1, T.LEVELS + 1)]).alias(f"{s}s") for s in ("bid", "ask")])
    path = new_path(spark)
    nested.write.parquet(path)
    return readers.book(spark, path, T.LEVELS, nested=True, ordered=False).select("book", *rounded({c: F.col(c) for c in _LEVELS}, 5))


@query(f"WITH {T.BOOK} SELECT book, {rounded_sql({c: c for c in _LEVELS}, 5)} FROM book")
def stored_books_from_zero(spark: SparkSession, sf: str) -> DataFrame:
    """Books whose files count levels from 0."""
    path = new_path(spark)
    T.book(spark, sf).select("book", *[F.col(c).alias(f"{c[:-1]}{int(c[-1]) - 1}") for c in _LEVELS]).write.parquet(path)
    return readers.book(spark, path, T.LEVELS, zero_indexed=True, ordered=False).select("book", *rounded({c: F.col(c) for c in _LEVELS}, 5))


@query(f"WITH {T.bars_sql()} SELECT symbol, ts, {rounded_sql({'open': 'open', 'close': 'close', 'vwap': 'vwap'}, 5)}, trades FROM bars")
def standard_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars under a feed's short names and milliseconds, made standard."""
    short = T.bars(spark, sf).select("symbol", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), F.col("open").cast("string").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"), F.col("vwap").alias("vw"), F.col("trades").cast("string").alias("n"))
    return readers.standard_bars(short).select("symbol", "ts", *rounded({c: F.col(c) for c in ("open", "close", "vwap")}, 5), "trades")


@query(f"WITH {T.TRADES} SELECT symbol, seq, ts FROM trades")
def standard_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Trades with nanoseconds, of which a second clock's stand in where the first's are missing."""
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + 999
    feed = T.trades(spark, sf).select("symbol", "seq", F.when(F.col("seq") % 3 == 0, ns).alias("sip_timestamp"), ns.alias("participant_timestamp"))
    return readers.standard_ticks(feed).select("symbol", "seq", "ts")


@query(f"WITH {T.TRADES}, d AS (SELECT unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY))::DATE AS day FROM trades) SELECT day::TIMESTAMP AS day, count(ts) AS trades FROM d LEFT JOIN trades ON ts::DATE = day GROUP BY day")
def trades_by_day(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.trades(spark, sf)
    ends = rows.agg(F.min("ts").cast("date").cast("string"), F.max("ts").cast("date").cast("string")).first()
    return readers.days(spark, *ends).join(rows.select(F.to_date("ts").alias("day"), "ts"), "day", "left").groupBy("day").agg(F.count("ts").alias("trades")).withColumn("day", F.col("day").cast("timestamp_ntz"))


MU, ALPHA, BETA = 0.01, 0.002, 0.0008


@query(f"WITH e AS (SELECT event_type AS symbol, event_id AS seq, epoch_us(ts) / 1e6 AS t FROM events) SELECT a.symbol, a.seq, {near_sql(f'{MU}::DOUBLE + {ALPHA}::DOUBLE * coalesce(sum(exp(-{BETA}::DOUBLE * (a.t - b.t))), 0)')} AS intensity FROM e a LEFT JOIN e b ON a.symbol = b.symbol AND b.t < a.t GROUP BY a.symbol, a.seq")
def hawkes_intensity(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.read(spark, sf, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"))
    return hawkes.intensity(rows, MU, ALPHA, BETA).select("symbol", "seq", near("intensity").alias("intensity"))


#: A fixed chain of three states over a bar's log range.
CHAIN = hmm.Model(["range"], np.array([0.5]), np.array([2.0]), np.array([0.5, 0.3, 0.2]), np.array([[0.85, 0.1, 0.05], [0.15, 0.75, 0.1], [0.05, 0.2, 0.75]]), np.array([[-0.25], [0.3], [1.2]]), np.array([[[0.04]], [[0.16]], [[0.5]]]), ["Calm", "Trending", "Volatile"])


def _density_sql(k: int) -> str:
    centre, var = float(CHAIN.centres[k, 0]), float(CHAIN.spreads[k, 0, 0])
    return f"(-0.5 * ((x - {centre!r}::DOUBLE) * (x - {centre!r}::DOUBLE) / {var!r}::DOUBLE + {float(np.log(2 * np.pi))!r}::DOUBLE) - {float(np.log(np.sqrt(var)))!r}::DOUBLE)"


def _step_sql(k: int) -> str:
    scores = [f"p.s{j} + {float(np.log(CHAIN.move[j, k]))!r}::DOUBLE" for j in range(3)]
    return f"greatest({', '.join(scores)}) + o.d{k} AS s{k}, CASE greatest({', '.join(scores)}) WHEN {scores[0]} THEN 0 WHEN {scores[1]} THEN 1 ELSE 2 END AS b{k}"


_START = ", ".join(f"d{k} + {float(np.log(CHAIN.start[k]))!r}::DOUBLE AS s{k}, -1 AS b{k}" for k in range(3))


@query(f"""WITH RECURSIVE {T.bars_sql()}, o AS (SELECT symbol, ts, n, {", ".join(f"{_density_sql(k)} AS d{k}" for k in range(3))} FROM (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n, (ln(high / low) - 0.5) / 2 AS x FROM bars WHERE high > 0 AND low > 0)),
f AS (SELECT symbol, n, {_START} FROM o WHERE n = 1 UNION ALL SELECT o.symbol, o.n, {", ".join(_step_sql(k) for k in range(3))} FROM f p JOIN o ON o.symbol = p.symbol AND o.n = p.n + 1),
e AS (SELECT symbol, max(n) AS n FROM f GROUP BY symbol),
g AS (SELECT f.symbol, f.n, CASE greatest(s0, s1, s2) WHEN s0 THEN 0 WHEN s1 THEN 1 ELSE 2 END AS state FROM f JOIN e USING (symbol, n)
 UNION ALL SELECT f.symbol, f.n - 1, CASE g.state WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END FROM g JOIN f ON f.symbol = g.symbol AND f.n = g.n WHERE f.n > 1)
SELECT g.symbol, o.ts, g.state::INTEGER AS state, ['Calm', 'Trending', 'Volatile'][g.state + 1] AS regime FROM g JOIN o ON o.symbol = g.symbol AND o.n = g.n""")
def hidden_states(spark: SparkSession, sf: str) -> DataFrame:
    """The most likely states of a fixed chain, worked out in segments of forty bars."""
    bars = T.ordered_bars(spark, sf).where("high > 0 and low > 0").withColumn("range", F.ln(F.col("high") / F.col("low")))
    return hmm.decode(bars, CHAIN, 40).select("symbol", "ts", "state", "regime")
