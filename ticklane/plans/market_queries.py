"""Queries on trades, quotes and bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import book as B
from ..functions.scalar import quotient
from ..functions.session import session_features, time_features
from ..operators import filters, micro, quality, resample, rolling
from ..operators.asof import asof_join, asof_join_all, interpolated_join
from . import tables as T
from .registry import near, near_sql, query, rounded, rounded_sql

HALF_DAY = 43_200.0
W = "PARTITION BY symbol ORDER BY ts, seq"
last = lambda k: f"OVER ({W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
SIDED = f"""{T.TRADES}, {T.QUOTES}, matched AS (SELECT t.*, CASE WHEN epoch_us(t.ts) - epoch_us(q.ts) <= {HALF_DAY:.0f} * 1000000::BIGINT THEN (q.bid_price + q.ask_price) / 2 END AS mid_price FROM trades t ASOF LEFT JOIN quotes q ON t.symbol = q.symbol AND t.ts >= q.ts),
sided AS (SELECT *, CASE WHEN price > mid_price THEN 1 WHEN price < mid_price THEN -1 ELSE 0 END AS side FROM matched)"""


def sided(spark: SparkSession, sf: str) -> DataFrame:
    return micro.classify(T.trades(spark, sf), T.quotes(spark, sf), HALF_DAY)


@query(f"WITH {SIDED} SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS ts, CAST(sum(CASE WHEN side > 0 THEN size ELSE 0 END) AS BIGINT) AS buy_volume, CAST(sum(CASE WHEN side < 0 THEN size ELSE 0 END) AS BIGINT) AS sell_volume, count(*) AS n FROM sided GROUP BY ALL")
def asof_signed_flow(spark: SparkSession, sf: str) -> DataFrame:
    s = micro.signed_sizes()
    return resample.aggregated(sided(spark, sf), T.DAY, {"buy_volume": F.sum(s["buy_volume"]), "sell_volume": F.sum(s["sell_volume"]), "n": F.count("*")})


@query(f"WITH {T.TRADES}, {T.QUOTES} SELECT t.symbol, t.ts, t.seq, q.ts AS quote_ts, q.seq AS quote_seq, round(q.bid_price + 3.1e-08::DOUBLE, 6) AS bid_price FROM trades t ASOF LEFT JOIN quotes q ON t.symbol = q.symbol AND t.ts >= q.ts")
def asof_backward(spark: SparkSession, sf: str) -> DataFrame:
    out = asof_join(T.trades(spark, sf), T.quotes(spark, sf), suffix="_q")
    return out.select("symbol", "ts", "seq", F.col("ts_q").alias("quote_ts"), F.col("seq_q").alias("quote_seq"), near("bid_price").alias("bid_price"))


@query(f"WITH {T.TRADES}, {T.QUOTES} SELECT t.symbol, t.ts, t.seq, q.ts AS quote_ts, q.seq AS quote_seq, round(q.bid_price + 3.1e-08::DOUBLE, 6) AS bid_price FROM trades t ASOF LEFT JOIN quotes q ON t.symbol = q.symbol AND t.ts >= q.ts")
def asof_backward_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """Same rows with each symbol split by week."""
    out = asof_join(T.trades(spark, sf), T.quotes(spark, sf), suffix="_q", bucket="week")
    return out.select("symbol", "ts", "seq", F.col("ts_q").alias("quote_ts"), F.col("seq_q").alias("quote_seq"), near("bid_price").alias("bid_price"))


@query(f"WITH {T.TRADES}, {T.QUOTES} SELECT t.symbol, t.ts, t.seq, q.seq AS quote_seq FROM trades t ASOF LEFT JOIN quotes q ON t.symbol = q.symbol AND t.ts <= q.ts")
def asof_forward(spark: SparkSession, sf: str) -> DataFrame:
    return asof_join(T.trades(spark, sf), T.quotes(spark, sf), direction="forward", suffix="_q").select("symbol", "ts", "seq", F.col("seq_q").alias("quote_seq"))


@query(f"""WITH {T.TRADES}, {T.QUOTES}, b AS (SELECT t.*, q.ts AS bts, q.seq AS bseq FROM trades t ASOF LEFT JOIN quotes q ON t.symbol = q.symbol AND t.ts >= q.ts),
f AS (SELECT b.*, q.ts AS fts, q.seq AS fseq FROM b ASOF LEFT JOIN quotes q ON b.symbol = q.symbol AND b.ts <= q.ts),
c AS (SELECT *, CASE WHEN fts IS NOT NULL AND (bts IS NULL OR epoch_us(fts) - epoch_us(ts) < epoch_us(ts) - epoch_us(bts)) THEN fseq ELSE bseq END AS s, CASE WHEN fts IS NOT NULL AND (bts IS NULL OR epoch_us(fts) - epoch_us(ts) < epoch_us(ts) - epoch_us(bts)) THEN epoch_us(fts) - epoch_us(ts) ELSE epoch_us(ts) - epoch_us(bts) END AS d FROM f)
SELECT symbol, ts, seq, CASE WHEN d <= 43200000000 THEN s END AS quote_seq FROM c""")
def asof_nearest_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    return asof_join(T.trades(spark, sf), T.quotes(spark, sf), HALF_DAY, "nearest", "_q").select("symbol", "ts", "seq", F.col("seq_q").alias("quote_seq"))


@query(f"""WITH {T.TRADES}, {T.QUOTES}, b AS (SELECT t.*, q.ts AS bts, q.bid_price AS bp FROM trades t ASOF LEFT JOIN quotes q ON t.symbol = q.symbol AND t.ts >= q.ts),
f AS (SELECT b.*, q.ts AS fts, q.bid_price AS fp FROM b ASOF LEFT JOIN quotes q ON b.symbol = q.symbol AND b.ts <= q.ts)
SELECT symbol, ts, seq, round(coalesce(bp + coalesce((epoch_us(ts) - epoch_us(bts)) / nullif((epoch_us(fts) - epoch_us(bts))::DOUBLE, 0), 0) * (fp - bp), bp, fp) + 3.1e-08::DOUBLE, 6) AS bid_price FROM f""")
def asof_interpolated(spark: SparkSession, sf: str) -> DataFrame:
    return interpolated_join(T.trades(spark, sf), T.quotes(spark, sf), ["bid_price"]).select("symbol", "ts", "seq", near("bid_price_interpolated").alias("bid_price"))


@query(f"WITH {T.bars_sql()} SELECT symbol, ts, open, high, low, close, volume, round(vwap + 3.1e-08::DOUBLE, 6) AS vwap, trades FROM bars")
def resample_ohlc(spark: SparkSession, sf: str) -> DataFrame:
    return T.bars(spark, sf).withColumn("vwap", near("vwap"))


@query(f"""WITH {SIDED}, s AS (SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS ts, count(*) AS trade_count, avg(side) AS mean_side, CAST(sum(size) AS BIGINT) AS total_size, CAST(sum(CASE WHEN side > 0 THEN size ELSE 0 END) AS BIGINT) AS b, CAST(sum(CASE WHEN side < 0 THEN size ELSE 0 END) AS BIGINT) AS se FROM sided GROUP BY ALL),
e AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM s GROUP BY symbol)
SELECT e.symbol, e.ts, coalesce(trade_count, 0) AS trade_count, round(mean_side + 3.1e-08::DOUBLE, 6) AS mean_side, coalesce(total_size, 0) AS total_size, coalesce(b, 0) AS buy_volume, coalesce(se, 0) AS sell_volume, round((b - se) / nullif(b + se, 0) + 3.1e-08::DOUBLE, 6) AS volume_imbalance, round(total_size / trade_count + 3.1e-08::DOUBLE, 6) AS avg_trade_size FROM e LEFT JOIN s USING (symbol, ts)""")
def resample_trade_features(spark: SparkSession, sf: str) -> DataFrame:
    out = resample.trade_features(sided(spark, sf), T.DAY)
    return out.select("symbol", "ts", "trade_count", near("mean_side").alias("mean_side"), "total_size", "buy_volume", "sell_volume", near("volume_imbalance").alias("volume_imbalance"), near("avg_trade_size").alias("avg_trade_size"))


@query(f"WITH {T.QUOTES} SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS ts, round(arg_max(bid_price, (ts, seq)) + 3.1e-08::DOUBLE, 6) AS bid_price, arg_max(ask_size, (ts, seq)) AS ask_size FROM quotes GROUP BY ALL")
def resample_quotes_last(spark: SparkSession, sf: str) -> DataFrame:
    return resample.last_values(T.quotes(spark, sf), T.DAY, ["bid_price", "ask_size"]).withColumn("bid_price", near("bid_price"))


@query(f"""WITH {T.TRADES}, {T.QUOTES}, u AS (SELECT symbol, ts FROM trades UNION ALL SELECT symbol, ts FROM quotes), e AS (SELECT symbol, unnest(generate_series(date_trunc('day', min(ts))::TIMESTAMP, date_trunc('day', max(ts))::TIMESTAMP, INTERVAL 1 DAY)) AS ts FROM u GROUP BY symbol),
t AS (SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS ts, avg(price) AS p, CAST(sum(size) AS BIGINT) AS v FROM trades GROUP BY ALL), q AS (SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS ts, arg_max(bid_price, (ts, seq)) AS b FROM quotes GROUP BY ALL)
SELECT symbol, ts, round(last_value(p IGNORE NULLS) OVER w + 3.1e-08::DOUBLE, 6) AS avg_trade_price, v AS total_trade_volume, round(last_value(b IGNORE NULLS) OVER w + 3.1e-08::DOUBLE, 6) AS bid_price FROM e LEFT JOIN t USING (symbol, ts) LEFT JOIN q USING (symbol, ts) WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def unified_timeline(spark: SparkSession, sf: str) -> DataFrame:
    out = resample.unified_timeline(T.trades(spark, sf), T.quotes(spark, sf), T.DAY, ["bid_price"])
    return out.select("symbol", "ts", near("avg_trade_price").alias("avg_trade_price"), "total_trade_volume", near("bid_price").alias("bid_price"))


_BOOKS = "books AS (SELECT user_id AS symbol, ts, event_id AS seq, value AS mid, CAST(json_extract(props, '$.k') AS BIGINT) AS depth FROM events WHERE event_type = 'error')"


@query(f"""WITH {T.TRADES}, {T.QUOTES}, {_BOOKS} SELECT t.symbol, t.ts, t.seq, q.seq AS quote_seq, {near_sql("q.bid_price")} AS bid_price, b.seq AS book_seq, b.mid, b.depth
FROM trades t ASOF LEFT JOIN quotes q ON t.symbol = q.symbol AND t.ts >= q.ts ASOF LEFT JOIN books b ON t.symbol = b.symbol AND t.ts >= b.ts""")
def asof_three_sides(spark: SparkSession, sf: str) -> DataFrame:
    sides = {"quote": T.quotes(spark, sf).select("symbol", "ts", "seq", "bid_price"), "book": T.books(spark, sf)}
    return asof_join_all(T.trades(spark, sf), sides).select("symbol", "ts", "seq", F.col("seq_quote").alias("quote_seq"), near("bid_price").alias("bid_price"), F.col("seq_book").alias("book_seq"), "mid", "depth")


@query(f"""WITH {T.TRADES}, {T.QUOTES}, {_BOOKS}, u AS (SELECT symbol, ts FROM trades UNION ALL SELECT symbol, ts FROM quotes UNION ALL SELECT symbol, ts FROM books), e AS (SELECT symbol, unnest(generate_series(date_trunc('day', min(ts))::TIMESTAMP, date_trunc('day', max(ts))::TIMESTAMP, INTERVAL 1 DAY)) AS ts FROM u GROUP BY symbol),
t AS (SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS ts, avg(price) AS p, CAST(sum(size) AS BIGINT) AS v FROM trades GROUP BY ALL), q AS (SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS ts, arg_max(bid_price, (ts, seq)) AS b FROM quotes GROUP BY ALL), k AS (SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS ts, arg_max(mid, (ts, seq)) AS m, arg_max(depth, (ts, seq)) AS d FROM books GROUP BY ALL)
SELECT symbol, ts, {near_sql("last_value(p IGNORE NULLS) OVER w")} AS avg_trade_price, v AS total_trade_volume, {near_sql("last_value(b IGNORE NULLS) OVER w")} AS bid_price, {near_sql("last_value(m IGNORE NULLS) OVER w")} AS mid, last_value(d IGNORE NULLS) OVER w AS depth FROM e LEFT JOIN t USING (symbol, ts) LEFT JOIN q USING (symbol, ts) LEFT JOIN k USING (symbol, ts) WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def unified_dataset(spark: SparkSession, sf: str) -> DataFrame:
    out = resample.unified_dataset(T.trades(spark, sf), {"quotes": (T.quotes(spark, sf), ["bid_price"]), "books": (T.books(spark, sf), ["mid", "depth"])}, T.DAY)
    return out.select("symbol", "ts", *[near(c).alias(c) for c in ("avg_trade_price", "bid_price", "mid")], "total_trade_volume", "depth")


RETURNS = f"{T.TRADES}, r AS (SELECT *, ln(price / lag(price) OVER ({W})) AS r FROM trades)"


@query(f"WITH {RETURNS} SELECT symbol, ts, seq, " + rounded_sql({"log_return": "r", "log_return_5": f"ln(price / lag(price, 5) OVER ({W}))", "simple_return": f"price / lag(price) OVER ({W}) - 1"}) + " FROM r")
def log_returns(spark: SparkSession, sf: str) -> DataFrame:
    return T.trades(spark, sf).select("symbol", "ts", "seq", *rounded({"log_return": rolling.log_return("price"), "log_return_5": rolling.log_return("price", 5), "simple_return": rolling.simple_return("price")}))


@query(f"WITH {RETURNS} SELECT symbol, ts, seq, " + rounded_sql({"vol_10": f"CASE WHEN count(r) {last(10)} >= 10 THEN stddev_samp(r) {last(10)} END", "vol_20_annual": f"CASE WHEN count(r) {last(20)} >= 20 THEN stddev_samp(r) {last(20)} * sqrt(98280) END", "realised_10": f"CASE WHEN count(r) {last(10)} >= 10 THEN sqrt(sum(r * r) {last(10)}) END"}, 5) + " FROM r")
def rolling_volatility(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.trades(spark, sf).withColumn("r", rolling.log_return("price"))
    return rows.select("symbol", "ts", "seq", *rounded({"vol_10": rolling.volatility("r", 10), "vol_20_annual": rolling.volatility("r", 20, annualise=True), "realised_10": rolling.realised_volatility("r", 10)}, 5))


@query(f"""WITH {T.TRADES} SELECT symbol, ts, seq, """ + rounded_sql({
    "running": f"sum(price * size) OVER ({W} ROWS UNBOUNDED PRECEDING) / sum(size) OVER ({W} ROWS UNBOUNDED PRECEDING)",
    "daily": "sum(price * size) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) / sum(size) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)",
    "last_20": f"sum(price * size) {last(20)} / sum(size) {last(20)}"}, 4) + " FROM trades")
def vwap(spark: SparkSession, sf: str) -> DataFrame:
    rows = rolling.with_vwap(T.trades(spark, sf), "price", "size", "_running")
    return rows.select("symbol", "ts", "seq", *rounded({"running": F.col("_running"), "daily": rolling.vwap("price", "size", daily=True), "last_20": rolling.vwap("price", "size", 20)}, 4))


GAPS = f"{T.TRADES}, g AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER ({W}))) / 1e6::DOUBLE AS gap FROM trades)"


@query(f"WITH {GAPS} SELECT symbol, ts, seq, " + rounded_sql({"gap": "gap", "rate": f"CASE WHEN count(gap) {last(20)} >= 1 THEN 19 * 3600::DOUBLE / (sum(gap) {last(20)} + 1e-10) END", "cv": f"CASE WHEN count(gap) {last(100)} >= 10 THEN stddev_samp(gap) {last(100)} / avg(gap) {last(100)} END", "size_ma_10": f"avg(size) {last(10)}"}) + ", coalesce(gap < 1, false) AS in_burst FROM g")
def arrivals(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.trades(spark, sf).withColumn("gap", rolling.inter_arrival())
    return rows.select("symbol", "ts", "seq", *rounded({"gap": F.col("gap"), "rate": rolling.arrival_rate("gap", 20, 3600.0), "cv": rolling.variation("gap", 100, 10), "size_ma_10": rolling.rolling_mean("size", 10, least=1)}), F.coalesce(F.col("gap") < 1, F.lit(False)).alias("in_burst"))


@query(f"""WITH {T.TRADES}, e AS (SELECT *, coalesce(abs(price - lag(price) OVER ({W})) > 100, false) AS c, size > 1.5 * avg(size) {last(20)} AS s FROM trades)
SELECT symbol, ts, seq, round((epoch_us(ts) - epoch_us(last_value(CASE WHEN c THEN ts END IGNORE NULLS) OVER p)) / 1e6::DOUBLE + 3.1e-08::DOUBLE, 6) AS since_change, round((epoch_us(ts) - epoch_us(last_value(CASE WHEN s THEN ts END IGNORE NULLS) OVER p)) / 1e6::DOUBLE + 3.1e-08::DOUBLE, 6) AS since_spike FROM e WINDOW p AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def time_since_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = rolling.with_time_since(T.trades(spark, sf), rolling.price_changed("price", 100.0), "since_change")
    rows = rolling.with_time_since(rows, rolling.volume_spiked("size", 1.5, 20), "since_spike")
    return rows.select("symbol", "ts", "seq", *rounded({"since_change": F.col("since_change"), "since_spike": F.col("since_spike")}))


@query(f"""WITH {SIDED} SELECT symbol, ts, seq, side, CASE WHEN mid_price IS NULL THEN 0 WHEN price > mid_price THEN 1 WHEN price < mid_price THEN -1 ELSE coalesce(sign(price - lag(price) OVER ({W}))::INT, 0) END AS tick_side, CASE WHEN lead(mid_price) OVER ({W}) IS NOT NULL AND mid_price IS NOT NULL THEN CAST(lead(mid_price) OVER ({W}) > mid_price AS INT) END AS target, """
       + rounded_sql({"impact_1": f"(lead(mid_price, 1) OVER ({W}) - mid_price) * side", "impact_5": f"(lead(mid_price, 5) OVER ({W}) - mid_price) * side", "temporary": "(price - mid_price) / mid_price", "permanent": f"(lead(price, 5) OVER ({W}) - price) / price", "per_share": "(price - mid_price) / mid_price / ln(1 + size)"}) + " FROM sided")
def trade_impact(spark: SparkSession, sf: str) -> DataFrame:
    p = micro.price_impact()
    return sided(spark, sf).select("symbol", "ts", "seq", "side", micro.tick_side().alias("tick_side"), micro.next_move().alias("target"), *rounded({"impact_1": rolling.impact("mid_price", 1, "side"), "impact_5": rolling.impact("mid_price", 5, "side"), "temporary": p["temporary_impact"], "permanent": p["permanent_impact"], "per_share": p["impact_per_share"]}))


@query(f"""WITH {SIDED}, c AS (SELECT *, CAST(floor(sum(size) OVER ({W} ROWS UNBOUNDED PRECEDING) / ((sum(size) OVER (PARTITION BY symbol)) / 10::DOUBLE)) AS BIGINT) AS volume_bucket FROM sided),
b AS (SELECT symbol, volume_bucket, abs(sum(CASE WHEN side > 0 THEN size ELSE 0 END) - sum(CASE WHEN side < 0 THEN size ELSE 0 END)) / sum(size) AS i FROM c GROUP BY ALL),
v AS (SELECT symbol, volume_bucket, avg(i) OVER (PARTITION BY symbol ORDER BY volume_bucket ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS vpin FROM b) SELECT symbol, ts, seq, volume_bucket, round(vpin + 3.1e-08::DOUBLE, 6) AS vpin FROM c JOIN v USING (symbol, volume_bucket)""")
def vpin(spark: SparkSession, sf: str) -> DataFrame:
    return rolling.with_vpin(sided(spark, sf), buckets=10, k=5).select("symbol", "ts", "seq", "volume_bucket", near("vpin").alias("vpin"))


BAR_SQL = {"estimated_spread": "high - low", "mid_price": "(high + low) / 2", "relative_spread": "(high - low) / ((high + low) / 2)", "typical_price": "(high + low + close) / 3", "vwap_deviation": "(close - vwap) / vwap", "price_range": "(high - low) / close", "intrabar_momentum": "(close - open) / open", "parkinson": "sqrt(ln(high / low) ** 2 / (4 * ln(2)))",
           "garman_klass": "CASE WHEN 0.5 * ln(high / low) ** 2 - (2 * ln(2) - 1) * ln(close / open) ** 2 >= 0 THEN sqrt(0.5 * ln(high / low) ** 2 - (2 * ln(2) - 1) * ln(close / open) ** 2) END"}


@query(f"WITH {T.bars_sql()} SELECT symbol, ts, {rounded_sql(BAR_SQL)} FROM bars")
def bar_features(spark: SparkSession, sf: str) -> DataFrame:
    return T.bars(spark, sf).select("symbol", "ts", *rounded(B.bar_features()))


@query(f"""WITH {T.bars_sql()}, r AS (SELECT *, 0 AS seq, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret, volume::DOUBLE AS vol FROM bars), x AS (SELECT *, lag(ret) OVER ({W}) AS pr, lag(vol) OVER ({W}) AS pv, CASE WHEN count(ret) {last(5)} >= 5 THEN sum(ret) {last(5)} END AS s5 FROM r)
SELECT symbol, ts, """ + rounded_sql({
    "ret": "ret", "roll_spread": f"coalesce(CASE WHEN count(ret) {last(12)} >= 12 THEN 2 * sqrt(greatest(-covar_samp(ret, pr) {last(11)}, 0)) END, 0)",
    "variance_ratio": f"coalesce(CASE WHEN count(ret) {last(12)} >= 12 THEN var_samp(s5) {last(8)} / nullif(5 * var_samp(ret) {last(12)}, 0) END, 1)",
    "rv_5": f"CASE WHEN count(ret) {last(5)} >= 5 THEN sqrt(sum(ret * ret) {last(5)}) END", "ret_skew": f"coalesce(CASE WHEN count(ret) {last(12)} >= 12 THEN skewness(ret) {last(12)} END, 0)",
    "vol_kurt": f"coalesce(CASE WHEN count(vol) {last(12)} >= 12 THEN kurtosis(vol) {last(12)} END, 0)", "vol_acf_1": f"coalesce(CASE WHEN count(vol) {last(12)} >= 12 THEN corr(vol, pv) {last(11)} END, 0)"}, 4) + " FROM x")
def bar_dynamics(spark: SparkSession, sf: str) -> DataFrame:
    out = rolling.with_bar_dynamics(T.ordered_bars(spark, sf), k=12, lags=(1, 5), signature=(1, 5))
    return out.select("symbol", "ts", *rounded({c: F.col(c) for c in ("ret", "roll_spread", "variance_ratio", "rv_5", "ret_skew", "vol_kurt", "vol_acf_1")}, 4))


def _ewma_sql(name: str, span: int) -> str:
    """Deviation of returns with weights by age: sums over all earlier rows of the symbol."""
    k = f"pow(1 - 2.0::DOUBLE / {span + 1}, a.i - b.i)"
    return f"""{name}_s AS (SELECT a.symbol, a.ts, count(*) AS n, sum({k}) AS w, sum({k} * b.x) AS wx, sum({k} * b.x * b.x) AS wxx, sum({k} * {k}) AS ww FROM r a JOIN r b ON a.symbol = b.symbol AND b.i <= a.i WHERE b.x IS NOT NULL GROUP BY ALL),
{name} AS (SELECT symbol, ts, CASE WHEN n >= 2 THEN sqrt(greatest(wxx / w - (wx / w) ** 2, 0) * w * w / nullif(w * w - ww, 0)) END AS v FROM {name}_s)"""


@query(f"WITH {T.bars_sql()}, r AS (SELECT symbol, ts, row_number() OVER w AS i, close / lag(close) OVER w - 1 AS x FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)), {_ewma_sql('f', 5)}, {_ewma_sql('s', 30)} SELECT r.symbol, r.ts, " + rounded_sql({"ewma_fast": "f.v", "ewma_slow": "s.v", "vol_regime": "coalesce(f.v / nullif(s.v, 0), 1)"}, 4) + " FROM r LEFT JOIN f ON f.symbol = r.symbol AND f.ts = r.ts LEFT JOIN s ON s.symbol = r.symbol AND s.ts = r.ts")
def bar_ewma(spark: SparkSession, sf: str) -> DataFrame:
    return rolling.with_bar_dynamics(T.ordered_bars(spark, sf)).select("symbol", "ts", *rounded({c: F.col(c) for c in ("ewma_fast", "ewma_slow", "vol_regime")}, 4))


@query(f"WITH {T.bars_sql()}, r AS (SELECT *, 0 AS seq, sqrt(ln(high / low) ** 2 / (4 * ln(2))) AS p FROM bars) SELECT symbol, ts, " + rounded_sql({"parkinson_5": f"avg(p) {last(5)}", "spread_std_5": f"stddev_samp(high - low) {last(5)}", "volume_relative": "volume / avg(volume) OVER (PARTITION BY symbol)", "volume_concentration": f"volume / avg(volume) {last(5)}"}) + " FROM r")
def bar_rolling(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.ordered_bars(spark, sf).withColumns({"p": B.bar_features()["parkinson"], "s": F.col("high") - F.col("low")})
    volume = F.col("volume").cast("double")
    return rows.select("symbol", "ts", *rounded({"parkinson_5": rolling.rolling_mean("p", 5, least=1), "spread_std_5": rolling.rolling_std("s", 5, least=1), "volume_relative": quotient(volume, F.avg("volume").over(rolling.KEYS.whole())), "volume_concentration": quotient(volume, F.avg("volume").over(rolling.KEYS.last(5)))}))


@query(f"""WITH s AS (SELECT event_id, ts, (hour(ts) * 3600 + minute(ts) * 60 + second(ts) - 34200) / 60.0::DOUBLE AS m FROM events)
SELECT event_id, CAST(hour(ts) AS INT) AS hour, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INT) AS seconds_since_midnight, round(sin(hour(ts) * 2 * pi() / 24) + 3.1e-08::DOUBLE, 6) AS hour_sin, round(cos(minute(ts) * 2 * pi() / 60) + 3.1e-08::DOUBLE, 6) AS minute_cos,
 round(m + 3.1e-08::DOUBLE, 6) AS minutes_since_open, m >= 0 AND m <= 390 AS is_market_hours, CASE WHEN m < 0 THEN 'pre_open' WHEN m <= 30 THEN 'open' WHEN m <= 120 THEN 'mid_morning' WHEN m <= 240 THEN 'lunch' WHEN m <= 330 THEN 'afternoon' WHEN m <= 390 THEN 'close' ELSE 'post_close' END AS session_part FROM s""")
def session_times(spark: SparkSession, sf: str) -> DataFrame:
    t, s = time_features("ts"), session_features("ts")
    return T.read(spark, sf, "events").select("event_id", t["hour"].alias("hour"), t["seconds_since_midnight"].alias("seconds_since_midnight"), *rounded({"hour_sin": t["hour_sin"], "minute_cos": t["minute_cos"]}), near(s["minutes_since_open"]).alias("minutes_since_open"), s["is_market_hours"].alias("is_market_hours"), s["session_part"].alias("session_part"))


@query("WITH t AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) % 60 AS c FROM events) SELECT event_id, CAST(c AS INT) AS condition FROM t WHERE c NOT IN (4,6,7,9,14,15,16,37,38,52,53,54,55,56)")
def filter_regular_trades(spark: SparkSession, sf: str) -> DataFrame:
    c = (F.get_json_object("props", "$.k").cast("long") % 60).cast("int")
    rows = T.read(spark, sf, "events").select("event_id", c.alias("condition"), F.array(c).alias("conditions"))
    return filters.regular_trades(rows).select("event_id", "condition")


@query(f"WITH {T.QUOTES} SELECT symbol, seq, round(bid_price + 3.1e-08::DOUBLE, 6) AS bid_price FROM quotes WHERE ask_price > bid_price AND bid_size > 10 AND ask_size > 0")
def filter_valid_quotes(spark: SparkSession, sf: str) -> DataFrame:
    return filters.valid_quotes(T.quotes(spark, sf).withColumn("bid_size", F.col("bid_size") - 10)).select("symbol", "seq", near("bid_price").alias("bid_price"))


@query(f"WITH {T.QUOTES}, g AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER ({W}))) / 1e6::DOUBLE AS gap FROM quotes) SELECT symbol, seq, round(gap + 3.1e-08::DOUBLE, 6) AS time_since_last_update, coalesce(gap > 3600, false) AS is_stale, gap IS NULL OR gap <= 7200 AS near FROM g")
def quote_staleness(spark: SparkSession, sf: str) -> DataFrame:
    stale = filters.with_staleness(T.quotes(spark, sf), 3600.0)
    close = filters.within_gap(T.quotes(spark, sf), 7200.0).select("symbol", "seq", F.lit(True).alias("near"))
    return stale.join(close, ["symbol", "seq"], "left").select("symbol", "seq", near("time_since_last_update").alias("time_since_last_update"), "is_stale", F.coalesce("near", F.lit(False)).alias("near"))


NBBO_SQL = {"mid_price": "(bid_price + ask_price) / 2", "quoted_spread": "ask_price - bid_price", "spread_bps": "(ask_price - bid_price) / ((bid_price + ask_price) / 2) * 1e4::DOUBLE", "weighted_mid_price": "(bid_price * ask_size + ask_price * bid_size) / (bid_size + ask_size)", "order_flow_imbalance": "(bid_size - ask_size) / (bid_size + ask_size)"}


@query(f"WITH {T.QUOTES} SELECT symbol, seq, {rounded_sql(NBBO_SQL)} FROM quotes")
def nbbo_features(spark: SparkSession, sf: str) -> DataFrame:
    made = B.nbbo()
    return T.quotes(spark, sf).select("symbol", "seq", *rounded({n: made[n] for n in NBBO_SQL}))


@query(f"WITH {T.TRADES}, g AS (SELECT symbol, lag(ts) OVER ({W}) AS gap_start, ts AS gap_end FROM trades) SELECT symbol, gap_start, gap_end, round((epoch_us(gap_end) - epoch_us(gap_start)) / 1e6::DOUBLE + 3.1e-08::DOUBLE, 6) AS gap_seconds FROM g WHERE epoch_us(gap_end) - epoch_us(gap_start) > 86400000000")
def detect_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return quality.gaps(T.trades(spark, sf), 86_400.0).withColumn("gap_seconds", near("gap_seconds"))


@query(f"""WITH s AS (SELECT user_id AS symbol, ts, event_id AS seq, value > 200 AS state FROM events), n AS (SELECT *, CASE WHEN row_number() OVER ({W}) > 1 AND state IS DISTINCT FROM lag(state) OVER ({W}) THEN 1 ELSE 0 END AS nw FROM s), r AS (SELECT *, sum(nw) OVER ({W} ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT symbol, seq, state, CAST(row_number() OVER (PARTITION BY symbol, run ORDER BY ts, seq) - CASE WHEN run = 0 THEN 1 ELSE 0 END AS INT) AS run_length FROM r""")
def regime_persistence(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.read(spark, sf, "events").select(F.col("user_id").alias("symbol"), "ts", F.col("event_id").alias("seq"), (F.col("value") > 200).alias("state"))
    return rolling.with_run_length(rows, "state").select("symbol", "seq", "state", "run_length")
