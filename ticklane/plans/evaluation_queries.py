"""Queries on predictions, backtests, data quality and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backtest, evaluate, quality, ranking
from . import tables as T
from .registry import near, near_sql, query, rounded, rounded_sql

P = T.PREDICTIONS
CONFUSION = "count(*) AS n, sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END)::DOUBLE AS fp, sum(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END)::DOUBLE AS fn, sum(CASE WHEN label = 0 AND prediction = 0 THEN 1 ELSE 0 END)::DOUBLE AS tn"
F1 = "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)"
CHANCE = "(((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n::DOUBLE * n))"
METRICS = {"accuracy": "(tp + tn) / n", "precision": "coalesce(tp / nullif(tp + fp, 0), 0)", "recall": "coalesce(tp / nullif(tp + fn, 0), 0)", "f1": F1, "kappa": f"coalesce(((tp + tn) / n - {CHANCE}) / nullif(1 - {CHANCE}, 0), 0)"}
CURVE = f"""{P}, t AS (SELECT *, 2 * abs(probability - 0.5) AS confidence, CASE WHEN regime = 'Volatile' THEN 0.5 ELSE 1.0 END::DOUBLE AS size, CASE WHEN prediction = 1 THEN 1 ELSE -1 END * "return" - 0.0005::DOUBLE AS net_return FROM predictions),
k AS (SELECT *, 100000 * product(1 + size * net_return) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS capital FROM t WHERE confidence >= 0.3)"""


@query(f"WITH {P}, c AS (SELECT regime, {CONFUSION} FROM predictions GROUP BY regime) SELECT regime, n, {rounded_sql(METRICS)} FROM c")
def metrics_by_regime(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.metrics(T.predictions(spark, sf), "regime").select("regime", "n", *rounded({c: F.col(c) for c in METRICS}))


@query(f"WITH {P} SELECT " + rounded_sql({"log_loss": "avg(-ln(CASE WHEN label = 1 THEN probability ELSE 1 - probability END))", "brier": "avg((probability - label) ** 2)"}) + " FROM predictions")
def probability_losses(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.metrics(T.predictions(spark, sf), probability="probability").select(*rounded({c: F.col(c) for c in ("log_loss", "brier")}))


@query(f"""WITH {P}, r AS (SELECT label, rank() OVER (ORDER BY probability) + (count(*) OVER (PARTITION BY probability) - 1) / 2.0::DOUBLE AS k FROM predictions)
SELECT {near_sql("(sum(CASE WHEN label = 1 THEN k END) - sum(label)::DOUBLE * (sum(label) + 1) / 2) / (sum(label)::DOUBLE * sum(1 - label))")} AS auc FROM r""")
def area_under_roc(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.auc(T.predictions(spark, sf)).select(*rounded({"auc": F.col("auc")}))


@query(f"""WITH {P}, s AS (SELECT probability AS threshold, sum(label) AS pos, sum(1 - label) AS neg FROM predictions GROUP BY probability)
SELECT threshold, {rounded_sql({"fpr": "sum(neg) OVER (ORDER BY threshold DESC) / (sum(neg) OVER ())::DOUBLE", "tpr": "sum(pos) OVER (ORDER BY threshold DESC) / (sum(pos) OVER ())::DOUBLE"})} FROM s""")
def roc_curve(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.roc_points(T.predictions(spark, sf)).select("threshold", *rounded({"fpr": F.col("fpr"), "tpr": F.col("tpr")}))


@query(f"WITH {P} SELECT CAST(least(floor(probability * 10), 9) AS INT) AS bin, count(*) AS n, {rounded_sql({'mean_predicted': 'avg(probability)', 'fraction_positive': 'avg(label)'})} FROM predictions GROUP BY ALL")
def calibration_curve(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.calibration(T.predictions(spark, sf)).select("bin", "n", *rounded({c: F.col(c) for c in ("mean_predicted", "fraction_positive")}))


@query(f"""WITH {P}, q AS (SELECT *, 2 * abs(probability - 0.5) AS c FROM predictions), s AS (SELECT *, CASE WHEN c < 0.6 THEN '[0,0.6)' WHEN c < 0.7 THEN '[0.6,0.7)' WHEN c < 0.8 THEN '[0.7,0.8)' WHEN c < 1 THEN '[0.8,1)' END AS stratum FROM q), g AS (SELECT stratum, {CONFUSION} FROM s WHERE stratum IS NOT NULL GROUP BY stratum)
SELECT stratum, n, {rounded_sql({"accuracy": METRICS["accuracy"], "f1": F1})} FROM g""")
def confidence_strata(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.confidence_strata(T.predictions(spark, sf)).select("stratum", "n", *rounded({"accuracy": F.col("accuracy"), "f1": F.col("f1")}))


@query(f"""WITH {P}, h AS (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS threshold), g AS (SELECT threshold, {CONFUSION} FROM predictions JOIN h ON 2 * abs(probability - 0.5) >= threshold GROUP BY threshold)
SELECT threshold, n, {rounded_sql({"accuracy": METRICS["accuracy"], "f1": F1})} FROM g""")
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.threshold_sweep(T.predictions(spark, sf)).select("threshold", "n", *rounded({"accuracy": F.col("accuracy"), "f1": F.col("f1")}))


@query()
def bootstrap_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.bootstrap_difference(T.predictions(spark, sf), "prediction", "other", ["symbol", "ts", "seq"])


@query(f"WITH {CURVE} SELECT symbol, seq, size, {rounded_sql({'net_return': 'net_return'})}, {rounded_sql({'capital': 'capital', 'pnl': 'capital - coalesce(lag(capital) OVER (PARTITION BY symbol ORDER BY ts, seq), 100000)'}, 3)} FROM k")
def backtest_trades(spark: SparkSession, sf: str) -> DataFrame:
    made = backtest.trades_of(T.predictions(spark, sf), 0.3, "regime")
    return made.select("symbol", "seq", "size", *rounded({"net_return": F.col("net_return")}), *rounded({"capital": F.col("capital"), "pnl": F.col("pnl")}, 3))


@query(f"""WITH {CURVE}, d AS (SELECT *, greatest(max(capital) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 100000) AS top FROM k),
g AS (SELECT symbol, count(*) AS n_trades, arg_max(capital, (ts, seq)) / 100000 - 1 AS total_return, coalesce(avg(net_return) / nullif(stddev_pop(net_return), 0), 0) * sqrt(252) AS sharpe, coalesce(avg(net_return) / nullif(stddev_pop(CASE WHEN net_return < 0 THEN net_return END), 0), 0) * sqrt(252) AS sortino,
 abs(min((capital - top) / top)) AS max_drawdown, avg(CAST(prediction = label AS INT)) AS win_rate FROM d GROUP BY symbol)
SELECT symbol, n_trades, {rounded_sql({"total_return": "total_return", "sharpe": "sharpe", "sortino": "sortino", "max_drawdown": "max_drawdown", "win_rate": "win_rate"}, 5)} FROM g""")
def backtest_performance(spark: SparkSession, sf: str) -> DataFrame:
    made = backtest.performance(backtest.trades_of(T.predictions(spark, sf), 0.3, "regime"))
    return made.select("symbol", "n_trades", *rounded({c: F.col(c) for c in ("total_return", "sharpe", "sortino", "max_drawdown", "win_rate")}, 5))


@query(f"""WITH {CURVE}, d AS (SELECT *, (capital - max(capital) OVER w) / max(capital) OVER w AS down FROM k WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)), i AS (SELECT *, down * 100 <= -1 AS inside FROM d),
e AS (SELECT *, sum(CASE WHEN inside AND NOT coalesce(b, false) THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS episode FROM (SELECT *, lag(inside) OVER (PARTITION BY symbol ORDER BY ts, seq) AS b FROM i))
SELECT symbol, min(ts) AS "start", max(ts) AS "end", {near_sql("abs(min(down))")} AS depth, count(*) AS "rows" FROM e WHERE inside GROUP BY symbol, episode""")
def drawdown_episodes(spark: SparkSession, sf: str) -> DataFrame:
    made = backtest.drawdown_episodes(backtest.trades_of(T.predictions(spark, sf), 0.3, "regime"))
    return made.select("symbol", "start", "end", *rounded({"depth": F.col("depth")}), "rows")


@query(f"""WITH {CURVE}, c AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS n, max(capital) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS top FROM k),
i AS (SELECT *, (capital - top) / top * 100 <= -1 AS inside FROM c), o AS (SELECT *, max(CASE WHEN NOT inside THEN n END) OVER (PARTITION BY symbol ORDER BY n) AS outside FROM i),
e AS (SELECT symbol, outside, min(ts) AS "start", min(n) AS first_n, max(n) AS last_n, max(top) AS peak FROM o WHERE inside GROUP BY symbol, outside)
SELECT e.symbol, e."start", {near_sql("any_value(peak)", 3)} AS peak, min(c.ts) AS recovery, min(c.n) - any_value(first_n) AS recovery_rows FROM e LEFT JOIN c ON c.symbol = e.symbol AND c.n > e.last_n AND c.capital >= e.peak GROUP BY e.symbol, e."start", e.outside""")
def drawdown_recovery(spark: SparkSession, sf: str) -> DataFrame:
    made = backtest.drawdown_episodes(backtest.trades_of(T.predictions(spark, sf), 0.3, "regime"))
    return made.select("symbol", "start", *rounded({"peak": F.col("peak")}, 3), "recovery", "recovery_rows")


@query(f"""WITH {CURVE}, p AS (SELECT symbol, capital - coalesce(lag(capital) OVER (PARTITION BY symbol ORDER BY ts, seq), 100000) AS pnl FROM k),
g AS (SELECT symbol, coalesce(sum(pnl) FILTER (pnl > 0), 0) AS won, abs(sum(pnl) FILTER (pnl < 0)) AS lost, coalesce(avg(pnl) FILTER (pnl > 0), 0) AS average_win, coalesce(avg(pnl) FILTER (pnl < 0), 0) AS average_loss FROM p GROUP BY symbol)
SELECT symbol, {rounded_sql({"profit_factor": "coalesce(won / nullif(lost, 0), 'inf'::DOUBLE)", "average_win": "average_win", "average_loss": "average_loss", "win_loss_ratio": "coalesce(abs(average_win / nullif(average_loss, 0)), 0)"}, 3)} FROM g""")
def backtest_gains(spark: SparkSession, sf: str) -> DataFrame:
    made = backtest.performance(backtest.trades_of(T.predictions(spark, sf), 0.3, "regime"))
    return made.select("symbol", *rounded({c: F.col(c) for c in ("profit_factor", "average_win", "average_loss", "win_loss_ratio")}, 3))


_OPTIONS = {"baseline": ("prediction", "probability", "1.0", 0.2), "regime_model": ("other", "q", "1.0", 0.2), "regime_sizing": ("prediction", "probability", "h", 0.2), "confidence": ("prediction", "probability", "1.0", 0.6), "combined": ("other", "q", "h", 0.6)}


@query(f"""WITH {T.PREDICTIONS}, r AS (SELECT *, CASE WHEN other = 1 THEN 0.5 + abs(probability - 0.5) * 0.9 ELSE 0.5 - abs(probability - 0.5) * 0.9 END AS q, CASE WHEN regime = 'Volatile' THEN 0.5 ELSE 1.0 END AS h FROM predictions),
s AS ({" UNION ALL ".join(f"SELECT '{n}' AS strategy, symbol, label, {p} AS prediction, {z}::DOUBLE AS size, (CASE WHEN {p} = 1 THEN 1 ELSE -1 END) * \"return\" - 0.0005::DOUBLE AS net FROM r WHERE 2 * abs({q} - 0.5) >= {least}" for n, (p, q, z, least) in _OPTIONS.items())})
SELECT strategy, symbol, count(*) AS n_trades, {near_sql("product(1 + size * net) - 1", 5)} AS total_return, {near_sql("avg(CAST(prediction = label AS INT))", 5)} AS win_rate, {near_sql("coalesce(avg(net) / nullif(stddev_pop(net), 0), 0) * sqrt(252)", 4)} AS sharpe FROM s GROUP BY ALL""")
def five_strategies(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("probability")
    rows = T.predictions(spark, sf).withColumns({"regime_probability": F.when(F.col("other") == 1, 0.5 + F.abs(p - 0.5) * 0.9).otherwise(0.5 - F.abs(p - 0.5) * 0.9), "regime_prediction": F.col("other")})
    made = backtest.strategy_performance(backtest.five_strategies(rows, 0.2, 0.6))
    return made.select("strategy", "symbol", "n_trades", *rounded({c: F.col(c) for c in ("total_return", "win_rate")}, 5), near("sharpe", 4).alias("sharpe"))


COLUMNS = ["l_quantity", "l_extendedprice", "l_discount"]
STATS = {"mean": "avg(x)", "std": "stddev_samp(x)", "p5": "quantile_cont(x, 0.05)", "p25": "quantile_cont(x, 0.25)", "p50": "quantile_cont(x, 0.5)", "p99": "quantile_cont(x, 0.99)", "skew": "skewness(x)", "kurtosis": "kurtosis(x)"}


@query("WITH l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS x FROM lineitem" for c in COLUMNS) + f"), s AS (SELECT feature, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM l GROUP BY feature), o AS (SELECT feature, count(*) AS n_outliers FROM l JOIN s USING (feature) WHERE x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a) GROUP BY feature) SELECT feature, count(x) AS \"count\", CAST(sum(CAST(x = 0 AS INT)) AS BIGINT) AS n_zeros, count(DISTINCT x) AS n_unique, coalesce(max(n_outliers), 0) AS n_outliers, {rounded_sql(STATS, 4)} FROM l LEFT JOIN o USING (feature) GROUP BY feature")
def summary_statistics(spark: SparkSession, sf: str) -> DataFrame:
    made = quality.summary_stats(T.read(spark, sf, "lineitem"), COLUMNS)
    return made.select("feature", "count", "n_zeros", "n_unique", "n_outliers", *rounded({c: F.col(c) for c in STATS}, 4))


@query("""WITH a AS (SELECT quantile_cont(l_quantity, 0.25) AS p, quantile_cont(l_quantity, 0.75) AS q FROM lineitem), x AS (SELECT l.* FROM lineitem l, a WHERE l_quantity BETWEEN p - 0.1 * (q - p) AND q + 0.1 * (q - p)),
b AS (SELECT quantile_cont(l_extendedprice, 0.25) AS p, quantile_cont(l_extendedprice, 0.75) AS q FROM x) SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM x, b WHERE l_extendedprice BETWEEN p - 0.1 * (q - p) AND q + 0.1 * (q - p)""")
def without_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return quality.without_outliers(T.read(spark, sf, "lineitem"), COLUMNS[:2], threshold=0.1).select("l_orderkey", "l_linenumber", *COLUMNS[:2])


@query("SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice) + 3.1e-08::DOUBLE, 6) AS correlation FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount) + 3.1e-08::DOUBLE, 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount) + 3.1e-08::DOUBLE, 6) FROM lineitem")
def correlations(spark: SparkSession, sf: str) -> DataFrame:
    return quality.correlations(T.read(spark, sf, "lineitem"), COLUMNS).select("a", "b", *rounded({"correlation": F.col("correlation")}))


@query(f"WITH {P} SELECT regime AS value, count(*) AS n, {near_sql('count(*) * 100.0::DOUBLE / sum(count(*)) OVER ()')} AS share FROM predictions GROUP BY regime")
def regime_shares(spark: SparkSession, sf: str) -> DataFrame:
    return quality.value_shares(T.predictions(spark, sf), "regime").select("value", "n", *rounded({"share": F.col("share")}))


@query(f"""WITH {P} SELECT CAST(hour(ts) AS INT) AS hour, {rounded_sql({r: f"sum(CASE WHEN regime = '{r}' THEN 100 ELSE 0 END) / count(*)::DOUBLE" for r in ("Calm", "Trending", "Volatile")})} FROM predictions GROUP BY ALL""")
def regime_by_hour(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.predictions(spark, sf).withColumn("hour", F.hour("ts"))
    return quality.row_shares(rows, "hour", "regime", ["Calm", "Trending", "Volatile"]).select("hour", *rounded({c: F.col(c) for c in ("Calm", "Trending", "Volatile")}))


@query(f"WITH {P}, s AS (SELECT symbol, regime, lag(regime) OVER (PARTITION BY symbol ORDER BY ts, seq) AS before FROM predictions), c AS (SELECT before, regime, count(*) AS n FROM s WHERE before IS NOT NULL GROUP BY ALL) SELECT before, regime, n, {near_sql('n / (sum(n) OVER (PARTITION BY before))::DOUBLE')} AS probability FROM c")
def regime_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.transitions(T.predictions(spark, sf), "regime").select("before", "regime", "n", *rounded({"probability": F.col("probability")}))


@query("""WITH p AS (SELECT p_brand AS feature, sum(p_retailprice) AS importance FROM part GROUP BY p_brand), r AS (SELECT *, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INT) AS rank FROM p)
SELECT feature, rank, round(sum(importance) OVER (ORDER BY rank) / sum(importance) OVER () + 3.1e-08::DOUBLE, 6) AS cumulative_share FROM r""")
def ranked_features(spark: SparkSession, sf: str) -> DataFrame:
    made = T.read(spark, sf, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.sum("p_retailprice").alias("importance"))
    return ranking.ranked(made).select("feature", "rank", *rounded({"cumulative_share": F.col("cumulative_share")}))


@query("WITH m AS (SELECT c_nationkey AS model, avg(c_acctbal) AS accuracy, count(*) AS latency FROM customer GROUP BY c_nationkey) SELECT model, latency FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.accuracy >= m.accuracy AND o.latency <= m.latency AND (o.accuracy > m.accuracy OR o.latency < m.latency))")
def pareto_frontier(spark: SparkSession, sf: str) -> DataFrame:
    made = T.read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("model")).agg(F.avg("c_acctbal").alias("accuracy"), F.count("*").alias("latency"))
    return ranking.pareto(made).select("model", "latency")
