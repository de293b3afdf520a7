"""Queries on filters, rolling book features, regimes, ensembles, strategies and fixed trees."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, backtest, evaluate, filters, hawkes, micro, models, quality, ranking, reduction, rolling, trees
from ..streaming import flows
from . import tables as T
from .evaluation_queries import CONFUSION, CURVE, METRICS
from .registry import near, near_sql, query, rounded, rounded_sql

P, BOOK = T.PREDICTIONS, T.BOOK


def _series(spark: SparkSession, sf: str) -> DataFrame:
    """Books as series: a hundred symbols, ordered by order key, a second apart."""
    key = F.col("book")
    return T.book(spark, sf).withColumns({"symbol": key % 100, "ts": F.timestamp_seconds(key), "seq": key})


SERIES = f"{BOOK}, series AS (SELECT *, book % 100 AS symbol, make_timestamp(CAST(book * 1000000 AS BIGINT)) AS ts, book AS seq FROM book)"
OVER = "(PARTITION BY symbol ORDER BY seq"


def _full_sql(f: str, x: str, k: int) -> str:
    over = f"OVER {OVER} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} >= {k} THEN {f}({x}) {over} END"


_PARTS = """parts AS (SELECT symbol, seq, (bid_volume_1 - ask_volume_1) / (bid_volume_1 + ask_volume_1 + 1e-10::DOUBLE) AS q,
 bid_volume_1 + bid_volume_2 + bid_volume_3 AS b, ask_volume_1 + ask_volume_2 + ask_volume_3 AS a, bid_volume_1 AS b1, ask_volume_1 AS a1 FROM series),
f AS (SELECT symbol, seq, q, b - a AS d, (b / 3 + a / 3) / 2 AS t, (b1 / (b + 1e-10::DOUBLE) + a1 / (a + 1e-10::DOUBLE)) / 2 AS c FROM parts)"""
_DYNAMICS = {
    "queue_imbalance_volatility": _full_sql("stddev_samp", "q", 20), "volume_difference_mean": _full_sql("avg", "d", 20), "volume_difference_mean_10": _full_sql("avg", "d", 10),
    "volume_difference_mean_30": _full_sql("avg", "d", 30), "volume_difference_mean_60": _full_sql("avg", "d", 60), "volume_difference_acceleration": f"d - lag(d, 20) OVER {OVER})",
    "thickness_volatility": _full_sql("stddev_samp", "t", 20), "thickness_change": f"t - lag(t) OVER {OVER})", "concentration_change": f"c - lag(c, 20) OVER {OVER})",
}


@query(f"WITH {SERIES}, {_PARTS} SELECT symbol, seq, {rounded_sql(_DYNAMICS, 4)} FROM f")
def book_dynamics(spark: SparkSession, sf: str) -> DataFrame:
    made = rolling.book_dynamics(T.LEVELS)
    return _series(spark, sf).withColumns(made).select("symbol", "seq", *rounded({n: F.col(n) for n in made}, 4))


@query(f"WITH {T.bars_sql()} SELECT symbol, ts, " + rounded_sql({"volume_relative": "volume / avg(volume) OVER (PARTITION BY symbol)", "volume_concentration": "volume / CASE WHEN count(volume) OVER w >= 5 THEN avg(volume) OVER w END"}) + " FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING)")
def relative_volume(spark: SparkSession, sf: str) -> DataFrame:
    made = rolling.relative_volume()
    return T.ordered_bars(spark, sf).withColumns(made).select("symbol", "ts", *rounded({n: F.col(n) for n in made}))


@query(f"WITH {T.TRADES} SELECT symbol, seq, CASE WHEN size % 2 = 0 THEN 'sell' ELSE 'buy' END AS side FROM trades")
def maker_sides(spark: SparkSession, sf: str) -> DataFrame:
    return T.trades(spark, sf).withColumn("is_buyer_maker", F.col("size") % 2 == 0).select("symbol", "seq", micro.side_of_maker().alias("side"))


@query(f"WITH {T.TRADES}, g AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER {OVER.replace('seq', 'ts, seq')})) AS gap FROM trades) SELECT symbol, seq, price FROM g WHERE gap IS NULL OR gap <= 3600000000")
def trades_within_gap(spark: SparkSession, sf: str) -> DataFrame:
    return filters.within_gap(T.trades(spark, sf), 3600.0).select("symbol", "seq", "price")


@query(f"WITH {P} SELECT symbol, seq, {near_sql('2 * abs(probability - 0.5)')} AS confidence FROM predictions WHERE 2 * abs(probability - 0.5) >= 0.61")
def confident_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return filters.confident(T.predictions(spark, sf), 0.61).select("symbol", "seq", near("confidence").alias("confidence"))


def _bounds_sql(step: int, c: str) -> str:
    return f"s{step + 1} AS (SELECT t.* FROM s{step} t, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM s{step}) WHERE {c} BETWEEN a - 3 * (b - a) AND b + 3 * (b - a))"


@query(f"WITH {T.bars_sql()}, s0 AS (SELECT * FROM bars WHERE open IS NOT NULL AND close IS NOT NULL), {_bounds_sql(0, 'open')}, {_bounds_sql(1, 'high')}, {_bounds_sql(2, 'low')}, {_bounds_sql(3, 'close')} SELECT symbol, ts, close FROM s4")
def cleaned_bars(spark: SparkSession, sf: str) -> DataFrame:
    return filters.cleaned(T.bars(spark, sf), ["open", "high", "low", "close"]).select("symbol", "ts", "close")


@query(f"WITH {T.TRADES}, x AS (SELECT symbol, ts, seq, CASE WHEN size % 5 <> 0 THEN price / size END AS v FROM trades) SELECT symbol, seq, {near_sql('coalesce(last_value(v IGNORE NULLS) OVER w, first_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)')} AS v FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)")
def filled_values(spark: SparkSession, sf: str) -> DataFrame:
    ratio = F.when(F.col("size") % 5 == 1, float("inf")).when(F.col("size") % 5 != 0, F.col("price") / F.col("size")).when(F.col("size") % 2 == 0, float("nan"))
    rows = T.trades(spark, sf).withColumn("v", F.when(F.col("size") % 5 == 1, F.col("price") / F.col("size")).otherwise(ratio))
    return filters.filled(rows, ["v"]).select("symbol", "seq", near("v").alias("v"))


@query("SELECT l_orderkey, l_linenumber, l_discount AS bid_price_0, l_tax AS ask_price_0, l_quantity AS bid_volume_0 FROM lineitem")
def zero_indexed_levels(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("bid_price_1"), F.col("l_tax").alias("ask_price_1"), F.col("l_quantity").alias("bid_volume_1"))
    return filters.zero_indexed_levels(rows)


@query(f"""WITH {T.TRADES}, {SERIES}, s AS (SELECT symbol, ts, seq, make_timestamp(CAST(seq * 1000000 AS BIGINT)) AS at FROM trades) SELECT s.symbol, s.seq, coalesce(b.book, -1) AS book, coalesce(b.bid_price_1, 0) AS bid_price_1, coalesce(b.ask_price_1, 0) AS ask_price_1 FROM s ASOF LEFT JOIN series b ON s.symbol % 100 = b.symbol AND s.at >= b.ts""")
def trades_with_book(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.trades(spark, sf).select((F.col("symbol") % 100).alias("symbol"), F.col("symbol").alias("trader"), F.timestamp_seconds("seq").alias("ts"), "seq")
    return asof.asof_join(rows, _series(spark, sf)).select(F.col("trader").alias("symbol"), "seq", "book", "bid_price_1", "ask_price_1").fillna({"book": -1, "bid_price_1": 0.0, "ask_price_1": 0.0})


@query(f"WITH {P}, c AS (SELECT regime, {CONFUSION} FROM predictions GROUP BY regime), d AS (SELECT regime, {CONFUSION.replace('prediction = ', 'other = ')} FROM predictions GROUP BY regime), x AS (SELECT regime, n, {', '.join(f'{METRICS[m]} AS {m}' for m in ('accuracy', 'f1'))} FROM c), y AS (SELECT regime, {', '.join(f'{METRICS[m]} AS {m}' for m in ('accuracy', 'f1'))} FROM d) SELECT regime, x.n, " + rounded_sql({"accuracy_a": "x.accuracy", "accuracy_b": "y.accuracy", "accuracy_delta": "y.accuracy - x.accuracy", "f1_delta_percent": "100 * (y.f1 - x.f1) / x.f1"}) + " FROM x JOIN y USING (regime)")
def global_against_conditional(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.compared(T.predictions(spark, sf), "prediction", "other", "regime").select("regime", "n", *rounded({c: F.col(c) for c in ("accuracy_a", "accuracy_b", "accuracy_delta", "f1_delta_percent")}))


@query(f"WITH {P}, m AS (SELECT *, 1 - probability / 2 AS q FROM predictions) SELECT symbol, seq, " + rounded_sql({"soft": "(2 * probability + q) / 3", "drawn": "greatest(0, least(1, 0.5 + (probability - 0.5) * CASE regime WHEN 'Volatile' THEN 1 + 0.5 * (0.4 - 0.5) * 2 WHEN 'Calm' THEN 1 + 0.5 * (0.8 - 0.5) * 2 ELSE 1 END))"}) + ", CAST(CASE WHEN probability >= 0.5 THEN 2 ELSE 0 END + CASE WHEN q >= 0.5 THEN 1 ELSE 0 END > 1.5 AS INT) AS hard FROM m")
def votes(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.predictions(spark, sf).withColumn("q", 1 - F.col("probability") / 2)
    both = ["probability", "q"]
    return rows.select("symbol", "seq", *rounded({"soft": models.vote(both, [2.0, 1.0]), "drawn": models.adjusted({"Volatile": 0.4, "Calm": 0.8})}), models.vote(both, [2.0, 1.0], "hard").alias("hard"))


@query(f"""WITH {CURVE}, d AS (SELECT *, (capital - greatest(max(capital) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 100000)) / greatest(max(capital) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 100000) AS down FROM k),
g AS (SELECT symbol, arg_max(capital, (ts, seq)) / 100000 - 1 AS total, -min(down) AS worst FROM d GROUP BY symbol) SELECT symbol, {near_sql('coalesce(total / nullif(worst, 0), 0)', 4)} AS calmar FROM g""")
def calmar_ratios(spark: SparkSession, sf: str) -> DataFrame:
    return backtest.performance(backtest.trades_of(T.predictions(spark, sf), 0.3, "regime")).select("symbol", near("calmar", 4).alias("calmar"))


@query(f"WITH {CURVE} SELECT regime, count(*) AS n, {rounded_sql({'hit_rate': 'avg(CAST(prediction = label AS INT))', 'confidence': 'avg(confidence)', 'size': 'avg(size)'})} FROM k GROUP BY regime")
def trades_by_regime(spark: SparkSession, sf: str) -> DataFrame:
    return backtest.by_regime(backtest.trades_of(T.predictions(spark, sf), 0.3, "regime")).select("regime", "n", *rounded({c: F.col(c) for c in ("hit_rate", "confidence", "size")}))


def _strategy_sql(name: str, size: str) -> str:
    return f"SELECT '{name}' AS strategy, symbol, count(*) AS n_trades, product(1 + {size} * net_return) - 1 AS total_return FROM k GROUP BY symbol"


@query(f"WITH {CURVE}, u AS ({_strategy_sql('fixed', '1')} UNION ALL {_strategy_sql('regime', 'size')} UNION ALL {_strategy_sql('confidence', 'confidence')}) SELECT strategy, symbol, n_trades, {near_sql('total_return', 5)} AS total_return FROM u")
def strategies_compared(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.predictions(spark, sf)
    return backtest.compared_strategies({k: backtest.trades_of(rows, 0.3, k) for k in ("fixed", "regime", "confidence")}).select("strategy", "symbol", "n_trades", near("total_return", 5).alias("total_return"))


@query(f"WITH {P} SELECT regime, " + rounded_sql({f"{c}_{n}": f'{f}("{c}")' for c in ("probability", "return") for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))}) + " FROM predictions GROUP BY regime")
def regime_group_stats(spark: SparkSession, sf: str) -> DataFrame:
    made = quality.group_stats(T.predictions(spark, sf), "regime", ["probability", "return"])
    return made.select("regime", *rounded({c: F.col(c) for c in made.columns if c != "regime"}))


@query(f"WITH {T.TRADES}, g AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol ORDER BY ts, seq))) / 1e6::DOUBLE AS gap FROM trades) SELECT count(*) AS rows, {rounded_sql({'gap_median': 'quantile_cont(gap, 0.5)', 'gap_mean': 'avg(gap)', 'gap_max': 'max(gap)'}, 4)}, CAST(count(*) FILTER (price IS NULL) AS BIGINT) AS price_missing, CAST(count(*) FILTER (price < 0) AS BIGINT) AS price_negative FROM g")
def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_report(T.trades(spark, sf), ["price"]).select("rows", *rounded({c: F.col(c) for c in ("gap_median", "gap_mean", "gap_max")}, 4), "price_missing", "price_negative")


@query(f"WITH {P}, i AS (SELECT regime AS feature, sum(probability) AS importance FROM predictions GROUP BY regime), j AS (SELECT regime AS feature, sum(label)::DOUBLE AS importance FROM predictions WHERE regime <> 'Calm' GROUP BY regime), s AS (SELECT coalesce(i.feature, j.feature) AS feature, coalesce(i.importance, 0) / (SELECT sum(importance) FROM i) AS a, coalesce(j.importance, 0) / (SELECT sum(importance) FROM j) AS b FROM i FULL JOIN j ON i.feature = j.feature) SELECT feature, {rounded_sql({'a': 'a', 'b': 'b', 'mean': '(a + b) / 2'})} FROM s")
def merged_importances(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.predictions(spark, sf).groupBy(F.col("regime").alias("feature"))
    a, b = rows.agg(F.sum("probability").alias("importance")), rows.agg(F.sum("label").cast("double").alias("importance")).where("feature != 'Calm'")
    return ranking.merged_importances({"a": a, "b": b}).select("feature", *rounded({c: F.col(c) for c in ("a", "b", "mean")}))


@query(f"WITH {P}, i AS (SELECT symbol AS feature, sum(probability) AS importance FROM predictions GROUP BY symbol), r AS (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS k, sum(importance) OVER (ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING) / sum(importance) OVER () AS share, count(*) OVER () AS n FROM i) SELECT percent::INT AS percent, {near_sql('max(share)', 5)} AS share FROM r, (SELECT unnest([10, 20, 50]) AS percent) WHERE k <= greatest(1, ceil(n * percent / 100.0)) GROUP BY percent")
def importance_concentration(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.predictions(spark, sf).groupBy(F.col("symbol").alias("feature")).agg(F.sum("probability").alias("importance"))
    return ranking.concentration(rows).select("percent", near("share", 5).alias("share"))


@query(f"WITH {P}, w AS (SELECT symbol, seq, probability AS branching_ratio FROM predictions), q AS (SELECT quantile_cont(branching_ratio, 0.75) AS hi, quantile_cont(branching_ratio, 0.5) AS mid FROM w) SELECT symbol, seq, CASE WHEN branching_ratio >= 0.7 THEN 'Excited' WHEN branching_ratio >= 0.3 THEN 'Normal' ELSE 'Calm' END AS regime, CASE WHEN branching_ratio >= hi THEN 'High Excitation' WHEN branching_ratio >= mid THEN 'Moderate' ELSE 'Baseline' END AS regime_hawkes FROM w, q")
def excitation_regimes(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.predictions(spark, sf).select("symbol", "seq", F.col("probability").alias("branching_ratio")).withColumn("regime", hawkes.regime_label())
    return hawkes.quantile_regime(rows).select("symbol", "seq", "regime", "regime_hawkes")


#: Fixed components of two columns, so that SQL can give their scores.
COMPONENTS = reduction.Components(["l_quantity", "l_discount"], np.array([25.0, 0.05]), np.array([14.0, 0.03]), np.array([[0.8, -0.6], [0.6, 0.8]]), np.array([0.7, 0.3]))


@query("WITH z AS (SELECT *, (l_quantity - 25.0) / 14.0::DOUBLE AS a, (l_discount - 0.05) / 0.03::DOUBLE AS b FROM lineitem) SELECT l_orderkey, l_linenumber, " + rounded_sql({"pc_1": "0.8::DOUBLE * a + 0.6::DOUBLE * b", "pc_2": "-0.6::DOUBLE * a + 0.8::DOUBLE * b"}) + " FROM z")
def component_scores(spark: SparkSession, sf: str) -> DataFrame:
    return COMPONENTS.transform(T.read(spark, sf, "lineitem")).select("l_orderkey", "l_linenumber", *rounded({c: F.col(c) for c in ("pc_1", "pc_2")}))


#: A fixed tree, so that SQL can give its leaves and values: (feature, threshold, left, right), leaves (value, weight).
TREE = trees.Tree.of(["l_quantity", "l_discount", "l_tax"], ("l_quantity", 20.0, ("l_discount", 0.04, (0.2, 30.0), (0.9, 10.0)), (0.6, 60.0)))
_LEAF = "CASE WHEN l_quantity <= 20 THEN CASE WHEN l_discount <= 0.04 THEN 0 ELSE 1 END ELSE 2 END"
_LINES = f"l AS (SELECT *, {_LEAF} AS leaf, CAST(l_tax > 0.04 AS INT) AS label FROM lineitem), v AS (SELECT *, [0.2, 0.9, 0.6][leaf + 1]::DOUBLE AS value, [['l_quantity <= 20', 'l_discount <= 0.04'], ['l_quantity <= 20', 'l_discount > 0.04'], ['l_quantity > 20']][leaf + 1] AS path FROM l)"


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    return trees.decision_paths(T.read(spark, sf, "lineitem").withColumn("label", (F.col("l_tax") > 0.04).cast("int")), TREE)


@query(f"WITH {_LINES} SELECT l_orderkey, l_linenumber, CAST(leaf AS INT) AS leaf, value, array_to_string(path, ' AND ') AS rules, CAST(len(path) AS INT) AS depth FROM v")
def tree_paths(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(spark, sf).select("l_orderkey", "l_linenumber", "leaf", "value", F.array_join("path", " AND ").alias("rules"), "depth")


@query(f"WITH {_LINES} SELECT CAST(leaf AS INT) AS leaf, count(*) AS n, {rounded_sql({'share': 'count(*) / (SELECT count(*) FROM v)::DOUBLE', 'accuracy': 'avg(CAST(CAST(value >= 0.5 AS INT) = label AS INT))'})}, CAST(max(value) >= 0.5 AS INT) AS predicted FROM v GROUP BY leaf")
def tree_leaves(spark: SparkSession, sf: str) -> DataFrame:
    return trees.leaf_statistics(_paths(spark, sf)).select("leaf", "n", *rounded({c: F.col(c) for c in ("share", "accuracy")}), "predicted")


@query(f"WITH {_LINES} SELECT {rounded_sql({'mean_depth': 'avg(len(path))', 'median_depth': 'quantile_cont(len(path), 0.5)', 'std_depth': 'stddev_pop(len(path))'})}, CAST(min(len(path)) AS INT) AS min_depth, CAST(max(len(path)) AS INT) AS max_depth FROM v")
def tree_depths(spark: SparkSession, sf: str) -> DataFrame:
    return trees.depth_statistics(_paths(spark, sf)).select(*rounded({c: F.col(c) for c in ("mean_depth", "median_depth", "std_depth")}), "min_depth", "max_depth")


@query(f"WITH {_LINES} SELECT l_orderkey, l_linenumber, {near_sql('CASE leaf WHEN 0 THEN 1.0 ELSE 1 / 3::DOUBLE END')} AS similarity FROM v WHERE leaf < 2")
def tree_similar_paths(spark: SparkSession, sf: str) -> DataFrame:
    return trees.similar_paths(_paths(spark, sf), ["l_quantity <= 20", "l_discount <= 0.04"], 0.3).select("l_orderkey", "l_linenumber", near("similarity").alias("similarity"))


# Values of the sets of known features: none, quantity, discount, both; the branches weigh 0.4 and 0.6, then 0.75 and 0.25.
_SETS = "e AS (SELECT *, CASE WHEN l_discount <= 0.04 THEN 0.2 ELSE 0.9 END::DOUBLE AS inner_v FROM v), s AS (SELECT *, 0.4::DOUBLE * (0.75 * 0.2 + 0.25 * 0.9) + 0.6 * 0.6 AS v0, CASE WHEN l_quantity <= 20 THEN 0.75::DOUBLE * 0.2 + 0.25 * 0.9 ELSE 0.6 END AS vq, 0.4::DOUBLE * inner_v + 0.6 * 0.6 AS vd FROM e)"


@query(f"WITH {_LINES}, {_SETS} SELECT l_orderkey, l_linenumber, " + rounded_sql({"quantity": "((vq - v0) + (value - vd)) / 2", "discount": "((vd - v0) + (value - vq)) / 2", "tax": "0.0::DOUBLE", "base": "v0"}) + " FROM s")
def tree_shap(spark: SparkSession, sf: str) -> DataFrame:
    valued = trees.with_shap(T.read(spark, sf, "lineitem"), [TREE])
    return valued.select("l_orderkey", "l_linenumber", *rounded({n: F.get("shap", F.lit(k)) for k, n in enumerate(("quantity", "discount", "tax"))} | {"base": F.col("shap_base")}))


@query(f"WITH {_LINES}, {_SETS}, a AS (SELECT avg(abs(((vq - v0) + (value - vd)) / 2)) AS l_quantity, avg(abs(((vd - v0) + (value - vq)) / 2)) AS l_discount, 0.0::DOUBLE AS l_tax FROM s) SELECT feature, {near_sql('importance')} AS importance FROM (UNPIVOT a ON l_quantity, l_discount, l_tax INTO NAME feature VALUE importance)")
def tree_shap_importance(spark: SparkSession, sf: str) -> DataFrame:
    valued = trees.with_shap(trees.cell_counts(T.read(spark, sf, "lineitem"), [TREE]), [TREE])
    return trees.shap_importance(valued, TREE.names, "rows").select("feature", near("importance").alias("importance"))


@query(f"WITH {_LINES}, {_SETS} SELECT 'l_quantity' AS a, 'l_discount' AS b, {near_sql('avg(abs((value - vq - vd + v0) / 2))')} AS strength FROM s UNION ALL SELECT 'l_quantity', 'l_tax', {near_sql('0.0')} UNION ALL SELECT 'l_discount', 'l_tax', {near_sql('0.0')}")
def tree_interactions(spark: SparkSession, sf: str) -> DataFrame:
    valued = trees.with_interactions(trees.cell_counts(T.read(spark, sf, "lineitem"), [TREE]), [TREE])
    return trees.interaction_strength(valued, TREE.names, "rows").select("a", "b", near("strength").alias("strength"))


_UPDATES = "u AS (SELECT l_suppkey AS symbol, l_orderkey AS last_id, l_orderkey - 1 - l_linenumber % 2 AS first_id FROM lineitem), b AS (SELECT DISTINCT symbol, CAST(100 + symbol % 50 AS BIGINT) AS base FROM u)"


@query(f"WITH {_UPDATES}, n AS (SELECT u.*, base FROM u JOIN b USING (symbol) WHERE last_id > base), f AS (SELECT symbol, arg_min(first_id, (last_id, first_id)) > min(base) + 1 AS gap FROM n GROUP BY symbol) SELECT b.symbol, 0::BIGINT AS first_id, base AS last_id, coalesce(gap, false) AS gap FROM b LEFT JOIN f USING (symbol) UNION ALL SELECT n.symbol, n.first_id, n.last_id, f.gap FROM n JOIN f USING (symbol) WHERE NOT f.gap")
def book_aligned_with_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    lines = T.read(spark, sf, "lineitem")
    none = F.array().cast("array<array<string>>")
    updates = lines.select(F.col("l_suppkey").alias("symbol"), (F.col("l_orderkey") - 1 - F.col("l_linenumber") % 2).cast("long").alias("first_id"), F.col("l_orderkey").cast("long").alias("last_id"), F.lit(None).cast("long").alias("previous_id"), none.alias("bids"), none.alias("asks"), F.lit(0).cast("long").alias("event_ms"))
    books = lines.select(F.col("l_suppkey").alias("symbol")).distinct().withColumns({"last_id": (100 + F.col("symbol") % 50).cast("long"), "bids": none, "asks": none})
    return flows.aligned_with_snapshot(updates, books).select("symbol", "first_id", "last_id", "gap")
