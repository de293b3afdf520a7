"""Evaluation of binary predictions (label 0/1, prediction 0/1, probability) as aggregations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import divide
from .order_stats import running


def _count(c: Column) -> Column:
    return F.sum(c.cast("double"))


def metrics(df: DataFrame, *by: str, label: str = "label", prediction: str = "prediction", probability: str | None = None) -> DataFrame:
    """accuracy, precision, recall, f1 (0 where undefined), kappa and log loss, overall or by columns."""
    y, p = F.col(label), F.col(prediction)
    counted = df.groupBy(*by).agg(
        F.count("*").alias("n"), _count((y == 1) & (p == 1)).alias("tp"), _count((y == 0) & (p == 1)).alias("fp"), _count((y == 1) & (p == 0)).alias("fn"), _count((y == 0) & (p == 0)).alias("tn"),
        *([F.avg(-F.ln(F.greatest(F.least(F.when(y == 1, F.col(probability)).otherwise(1 - F.col(probability)), F.lit(1 - 1e-15)), F.lit(1e-15)))).alias("log_loss"), F.avg((F.col(probability) - y) ** 2).alias("brier")] if probability else []),
    )
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    chance = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    right = (tp + tn) / n
    return counted.withColumns({"accuracy": right, "precision": zero(divide(tp, tp + fp)), "recall": zero(divide(tp, tp + fn)), "f1": zero(divide(2 * tp, 2 * tp + fp + fn)), "kappa": zero(divide(right - chance, 1 - chance))})


def auc(df: DataFrame, label: str = "label", probability: str = "probability") -> DataFrame:
    """One row (auc): ties count half; null with one class only. Scores are counted and summed in ranges (see order_stats)."""
    scores = running(df, probability, {"pos": _count(F.col(label) == 1), "neg": _count(F.col(label) == 0)}, [])
    return scores.agg(divide(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))


def roc_points(df: DataFrame, label: str = "label", probability: str = "probability") -> DataFrame:
    """(threshold, fpr, tpr) for each distinct score: shares of the rows with at least that score."""
    scores = running(df, probability, {"pos": _count(F.col(label) == 1), "neg": _count(F.col(label) == 0)}, [])
    total = scores.agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return scores.join(F.broadcast(total), F.lit(True)).select(F.col(probability).alias("threshold"), divide(F.col("_n") - F.col("neg_below"), F.col("_n")).alias("fpr"), divide(F.col("_p") - F.col("pos_below"), F.col("_p")).alias("tpr"))


def calibration(df: DataFrame, bins: int = 10, label: str = "label", probability: str = "probability") -> DataFrame:
    """Per uniform bin of the probability: n, mean prediction, fraction of positives."""
    at = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(probability).alias("mean_predicted"), F.avg(F.col(label).cast("double")).alias("fraction_positive"))


def confidence_strata(df: DataFrame, edges: tuple[float, ...] = (0.0, 0.6, 0.7, 0.8, 1.0), probability: str = "probability") -> DataFrame:
    """metrics per stratum of 2|p - 0.5|; a confidence of the last edge is in none."""
    c = 2 * F.abs(F.col(probability) - 0.5)
    stratum = F.lit(None).cast("string")
    for a, b in zip(edges, edges[1:]):
        stratum = F.when((c >= a) & (c < b), f"[{a:g},{b:g})").otherwise(stratum)
    return metrics(df.withColumn("stratum", stratum).where("stratum is not null"), "stratum").select("stratum", "n", "accuracy", "f1")


def threshold_sweep(df: DataFrame, thresholds: tuple[float, ...] = (0.5, 0.6, 0.7, 0.8, 0.9), probability: str = "probability") -> DataFrame:
    """metrics of the rows that each confidence threshold keeps, in one pass."""
    c = 2 * F.abs(F.col(probability) - 0.5)
    met = F.filter(F.array(*map(F.lit, thresholds)), lambda t: c >= t)
    return metrics(df.withColumn("threshold", F.explode(met)), "threshold").select("threshold", "n", "accuracy", "f1")


#: Poisson(1): probabilities of at most 0, 1, ... 6.
_POISSON = np.array([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119])


def poisson_weights(key: np.ndarray, round: int) -> np.ndarray:
    """Poisson(1) weights of rows in a round of a bootstrap, drawn from 64-bit hashes of the rows' keys."""
    x = key.view(np.uint64) + np.uint64((round + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x = x ^ (x >> np.uint64(31))
    return np.searchsorted(_POISSON, (x >> np.uint64(11)) / 2.0**53)


def bootstrap_sums(df: DataFrame, values: dict[str, Column], keys: list[str], rounds: int = 1000, seed: int = 42) -> DataFrame:
    """(round, n, each of values): per round of a Poisson bootstrap the sums of weights and of weighted values.

    A row's weights are drawn from a hash of its keys, so they depend neither on its place nor on the partitioning; rows of equal keys get equal
    weights. Each task gives one row per round.
    """
    names = list(values)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((rounds, 1 + len(names)))
        for b in batches:
            v = np.stack([np.ones(b.num_rows), *[b.column(n).to_numpy(zero_copy_only=False) for n in names]], 1)
            key = b.column("_key").to_numpy()
            for r in range(rounds):
                sums[r] += poisson_weights(key, r) @ v
        yield pa.record_batch([pa.array(np.arange(rounds, dtype=np.int32)), *[pa.array(np.ascontiguousarray(c)) for c in sums.T]], ["round", "n", *names])

    rows = df.select(F.xxhash64(F.lit(seed), *keys).alias("_key"), *[c.cast("double").alias(n) for n, c in values.items()]).dropna()
    kinds = ", ".join(f"{n} double" for n in ("n", *names))
    return rows.mapInArrow(scan, f"round int, {kinds}").groupBy("round").agg(*[F.sum(n).alias(n) for n in ("n", *names)])


def _scored(prefix: str, score: str) -> Column:
    tp, fp, fn, tn = (F.col(f"{prefix}_{x}") for x in ("tp", "fp", "fn", "tn"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return {"accuracy": divide(tp + tn, tp + fp + fn + tn), "precision": zero(divide(tp, tp + fp)), "recall": zero(divide(tp, tp + fn)), "f1": zero(divide(2 * tp, 2 * tp + fp + fn))}[score]


def bootstrap_difference(df: DataFrame, a: str, b: str, keys: list[str], label: str = "label", score: str = "accuracy", rounds: int = 1000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Paired Poisson bootstrap of a score (accuracy, precision, recall, f1) of prediction a less that of b: difference, one-sided p value and percentile interval. keys identify a row."""
    y = F.col(label)
    cells = {f"{side}_{n}": ((y == k) & (F.col(c) == p)).cast("double") for side, c in (("a", a), ("b", b)) for n, k, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))}
    diff = (_scored("a", score) - _scored("b", score)).alias("diff")
    each = bootstrap_sums(df, cells, keys, rounds, seed).select(diff)
    whole = df.select(*[c.alias(n) for n, c in cells.items()]).agg(*[F.sum(n).alias(n) for n in cells]).select(diff.alias("difference"))
    return whole.join(_spread(each, alpha), F.lit(True))


def _spread(each: DataFrame, alpha: float) -> DataFrame:
    """p value and interval of a table of one diff per round."""
    return each.agg(F.avg((F.col("diff") <= 0).cast("double")).alias("p_value"), F.percentile("diff", F.lit(alpha / 2)).alias("low"), F.percentile("diff", F.lit(1 - alpha / 2)).alias("high"))


def bootstrap_sharpe(a: DataFrame, b: DataFrame, keys: list[str], returns: str = "net_return", rounds: int = 1000, per_year: int = 252, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Independent bootstraps of two series' Sharpe ratios: difference, p value and interval of a's less b's."""
    r = F.col(returns)

    def ratio(n: Column, x: Column, xx: Column) -> Column:
        mean = divide(x, n)
        spread = F.sqrt(F.greatest(divide(xx, n) - mean * mean, F.lit(0.0)))
        return F.coalesce(divide(mean, spread), F.lit(0.0)) * float(np.sqrt(per_year))

    def drawn(df: DataFrame, name: str, seed: int) -> DataFrame:
        return bootstrap_sums(df, {"x": r, "xx": r * r}, keys, rounds, seed).select("round", ratio(F.col("n"), F.col("x"), F.col("xx")).alias(name))

    def whole(df: DataFrame, name: str) -> DataFrame:
        return df.agg(ratio(F.count(returns).cast("double"), F.sum(r), F.sum(r * r)).alias(name))

    each = drawn(a, "a", seed).join(drawn(b, "b", seed + 1), "round").select((F.col("a") - F.col("b")).alias("diff"))
    both = whole(a, "sharpe_a").join(whole(b, "sharpe_b"), F.lit(True)).withColumn("difference", F.col("sharpe_a") - F.col("sharpe_b"))
    return both.join(_spread(each, alpha), F.lit(True))


def compared(df: DataFrame, a: str, b: str, *by: str, label: str = "label") -> DataFrame:
    """metrics of predictions a and b side by side, overall or by columns, with the differences b - a and their percentage of a's; null where a's is 0."""
    names = ("accuracy", "precision", "recall", "f1")
    side = lambda p, s: metrics(df, *by, label=label, prediction=p).select(*by, "n", *[F.col(n).alias(f"{n}_{s}") for n in names])
    one, two = side(a, "a"), side(b, "b").drop("n")
    both = one.join(two, list(by)) if by else one.join(two, F.lit(True))
    return both.withColumns({k: v for n in names for k, v in ((f"{n}_delta", F.col(f"{n}_b") - F.col(f"{n}_a")), (f"{n}_delta_percent", divide(100 * (F.col(f"{n}_b") - F.col(f"{n}_a")), F.col(f"{n}_a"))))})


def compared_models(df: DataFrame, models: dict[str, str], keys: list[str], score: str = "f1", rounds: int = 1000, label: str = "label", seed: int = 42) -> DataFrame:
    """One table of several models' predictions (name -> column): their metrics, and against the best by a score the difference, its bootstrap interval and p value (null for the best itself). keys identify a row."""
    each = reduce(DataFrame.unionByName, [metrics(df, label=label, prediction=c).withColumn("model", F.lit(n)) for n, c in models.items()])
    rows = {r["model"]: r[score] for r in each.select("model", score).collect()}
    best = max(rows, key=lambda n: (rows[n], n))
    against = [bootstrap_difference(df, models[best], c, keys, label, score, rounds, seed=seed).withColumn("model", F.lit(n)) for n, c in models.items() if n != best]
    if not against:
        return each.select("model", *[c for c in each.columns if c != "model"])
    return each.join(reduce(DataFrame.unionByName, against), "model", "left").orderBy(F.desc(score), "model")
