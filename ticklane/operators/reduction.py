"""Principal components of standardised columns, their stability and drift. The data stay distributed: only the correlation matrix (columns by columns) reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Components:
    """loadings: columns by components, the largest weight of each positive; ratios: shares of variance."""

    columns: list[str]
    mean: np.ndarray
    scale: np.ndarray
    loadings: np.ndarray
    ratios: np.ndarray

    def transform(self, df: DataFrame) -> DataFrame:
        """df with pc_1, pc_2, ... as column expressions."""
        z = [(F.col(c) - float(m)) / float(s) for c, m, s in zip(self.columns, self.mean, self.scale)]
        return df.withColumns({f"pc_{k + 1}": reduce(lambda a, b: a + b, [x * float(w) for x, w in zip(z, self.loadings[:, k])]) for k in range(self.loadings.shape[1])})

    def top(self, k: int, n: int = 10) -> list[tuple[str, float]]:
        """The n columns of the largest weights in component k."""
        return [(self.columns[i], float(self.loadings[i, k])) for i in np.argsort(-np.abs(self.loadings[:, k]), kind="stable")[:n]]


#: A window's moments: rows, means, and sums of products of deviations from them (flat).
MOMENTS = "window long, n long, mean array<double>, products array<double>"
#: Groups that the tasks' moments are merged in before the last merge.
MERGED = 256


def _joined(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Moments of several groups of rows as those of all."""
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    return n, mean, sum(p[2] + p[0] * np.outer(p[1] - mean, p[1] - mean) for p in parts)


def moments(df: DataFrame, columns: list[str], window: Column | None = None) -> DataFrame:
    """(window, n, mean, products) of the complete rows: each task sums up its own, and these are merged in two steps, so no task merges more than a share of the tasks' matrices. One pass over df."""
    k = len(columns)
    window = F.lit(0) if window is None else window
    rows = df.select(window.cast("long").alias("window"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).dropna()
    schema = pa.schema([("window", pa.int64()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("products", pa.list_(pa.float64()))])

    def out(sums: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"window": w, "n": int(n), "mean": m.tolist(), "products": p.ravel().tolist()} for w, (n, m, p) in sums.items()], schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for b in batches:
            of, x = b.column(0).to_numpy(), np.stack([c.to_numpy() for c in b.columns[1:]], 1)
            for w in np.unique(of).tolist():
                own = x[of == w]
                mean = own.mean(0)
                part = (len(own), mean, (own - mean).T @ (own - mean))
                sums[w] = _joined([sums[w], part]) if w in sums else part
        yield out(sums)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for b in batches:
            for r in b.to_pylist():
                part = (r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(k, k))
                sums[r["window"]] = _joined([sums[r["window"]], part]) if r["window"] in sums else part
        yield out(sums)

    each = rows.mapInArrow(task, MOMENTS).withColumn("_share", F.spark_partition_id() % MERGED)
    shares = each.repartition("window", "_share").drop("_share").mapInArrow(merge, MOMENTS)
    return shares.repartition("window").mapInArrow(merge, MOMENTS)


def components(columns: list[str], n: int, mean: np.ndarray, products: np.ndarray, variance: float = 0.9, most: int | None = None) -> Components:
    """Components of the correlations that moments give."""
    scale = np.sqrt(np.diag(products) / max(n, 1))
    scale[scale == 0] = 1.0
    matrix = products / max(n, 1) / np.outer(scale, scale)
    np.fill_diagonal(matrix, 1.0)
    values, weights = np.linalg.eigh(matrix)
    order = np.argsort(-values)
    values, weights = np.clip(values[order], 0, None), weights[:, order]
    weights = weights * np.sign(weights[np.abs(weights).argmax(0), np.arange(len(columns))])
    ratios = values / values.sum()
    k = most or int(np.searchsorted(np.cumsum(ratios), variance - 1e-12) + 1)
    return Components(columns, mean, scale, weights[:, :k], ratios[:k])


def _collected(table: DataFrame, k: int) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """A row per window."""
    return {r["window"]: (r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(k, k)) for r in table.collect()}


def fit(df: DataFrame, columns: list[str], variance: float = 0.9, n: int | None = None) -> Components:
    """The fewest components that hold `variance`, or n, from one pass over df."""
    found = _collected(moments(df, columns), len(columns))
    return components(columns, *found.get(0, (0, np.zeros(len(columns)), np.zeros((len(columns),) * 2))), variance, n)


def loadings(model: Components) -> list[dict]:
    """A row per column with its weight in each component."""
    return [{"column": c, **{f"pc_{k + 1}": float(w) for k, w in enumerate(row)}} for c, row in zip(model.columns, model.loadings)]


def similarity(a: Components, b: Components, n: int = 5) -> float:
    """Mean absolute correlation of the first loadings."""
    k = min(n, a.loadings.shape[1], b.loadings.shape[1])
    return float(np.mean([abs(np.corrcoef(a.loadings[:, i], b.loadings[:, i])[0, 1]) for i in range(k)]))


def stability(df: DataFrame, columns: list[str], order: str, windows: int = 5, variance: float = 0.9) -> dict:
    """Similarity of the components of contiguous windows to those of all rows. Bounds are approximate quantiles of `order`, so nothing is sorted as a whole; all windows come from one pass."""
    at = F.col(order).cast("timestamp").cast("double") if "timestamp" in df.schema[order].dataType.simpleString() else F.col(order).cast("double")
    rows = df.withColumn("_order", at)
    cuts = rows.approxQuantile("_order", [k / windows for k in range(1, windows)], 0.001)
    number = sum(((F.col("_order") > c).cast("long") for c in cuts), F.lit(0))
    each = _collected(moments(rows, columns, number), len(columns))
    whole = components(columns, *_joined(list(each.values())), variance)
    found = [similarity(whole, components(columns, *each[w], most=whole.loadings.shape[1])) for w in sorted(each)]
    mean = float(np.mean(found))
    return {"similarities": found, "mean": mean, "verdict": "STABLE" if mean > 0.8 else "MODERATE" if mean > 0.6 else "UNSTABLE"}


def drift(baseline: Components, new: DataFrame, threshold: float = 0.7) -> dict:
    found = similarity(baseline, fit(new, baseline.columns, n=baseline.loadings.shape[1]))
    return {"similarity": found, "drift": found < threshold, "severe": found < 0.6}
