"""Classifiers with temporal validation, regime dispatch, voting and model inspection on Spark ML."""

from __future__ import annotations

import itertools
import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from queue import Queue
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .evaluate import metrics, poisson_weights
from .lineage import materialised
from .trees import Tree, TreeArrays, dependence, trees_of

KINDS = {
    "tree": lambda **p: DecisionTreeClassifier(**{"impurity": "entropy", "maxDepth": 7, "minInstancesPerNode": 10, "seed": 42} | p),
    "forest": lambda **p: RandomForestClassifier(**{"numTrees": 100, "featureSubsetStrategy": "sqrt", "maxDepth": 10, "seed": 42} | p),
    "boosting": lambda **p: GBTClassifier(**{"maxIter": 200, "stepSize": 0.1, "maxDepth": 5, "subsamplingRate": 0.8, "seed": 42} | p),
    "logistic": lambda **p: LogisticRegression(**{"elasticNetParam": 0.0, "regParam": 0.001} | p),
}


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """df with a weight of n / (classes * class size), the class sizes taken to the driver."""
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    weight = F.lit(None).cast("double")
    for y, n in sizes.items():
        weight = F.when(F.col(label) == y, sum(sizes.values()) / (len(sizes) * n)).otherwise(weight)
    return df.withColumn("_weight", weight)


def prepared(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """The complete rows of df with features and class-balancing weight, computed once: what the fits of one training set share."""
    assembler = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip")
    return materialised(assembler.transform(balanced(df, label)).select("_features", "_weight", F.col(label).alias("_label")))


def train(df: DataFrame, features: list[str], kind: str = "forest", label: str = "label", **params) -> PipelineModel:
    """An assembler and a class-balanced classifier fitted on the complete rows of df."""
    return fitted(prepared(df, features, label), features, kind, **params)


def fitted(rows: DataFrame, features: list[str], kind: str, weight: str = "_weight", **params) -> PipelineModel:
    """A model of prepared rows, as train gives it."""
    learner = KINDS[kind](**params).setLabelCol("_label").setFeaturesCol("_features").setWeightCol(weight)
    return PipelineModel([VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip"), learner.fit(rows)])


def concurrently(spark: SparkSession, jobs: list[Callable[[], Any]], workers: int = 8) -> list:
    """Results of functions that run Spark jobs, so many of them at once, each worker in a scheduler pool of its own (they share executors fairly with spark.scheduler.mode=FAIR, and fill gaps in any mode)."""
    pools: Queue[str] = Queue()
    for k in range(workers):
        pools.put(f"fit-{k}")

    def run(job: Callable[[], Any]) -> Any:
        pool = pools.get()
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
        try:
            return job()
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
            pools.put(pool)

    with ThreadPoolExecutor(workers) as threads:
        return [f.result() for f in [threads.submit(inheritable_thread_target(spark)(run), job) for job in jobs]]


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with prediction (0/1) and probability of class 1."""
    out = model.transform(df)
    p = vector_to_array("probability")[1]
    return out.withColumns({"_p": p, "prediction": F.col("prediction").cast("int")}).drop("_features", "rawPrediction", "probability").withColumnRenamed("_p", "probability")


def _order(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def time_cuts(df: DataFrame, shares: list[float], ts: str = "ts") -> list[int]:
    """Times in microseconds below which the given shares of rows lie, approximate to one in 10,000 rows, so nothing is sorted as a whole."""
    return df.select(_order(ts).cast("double").alias("_t")).approxQuantile("_t", shares, 0.0001)


def temporal_split(df: DataFrame, share: float = 0.8, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """The earliest share of rows and the rest; rows of the cut's time go to the first."""
    cut = time_cuts(df, [share], ts)[0]
    return df.where(_order(ts) <= cut), df.where(_order(ts) > cut)


def expanding_folds(df: DataFrame, n: int = 5, ts: str = "ts") -> Iterator[tuple[DataFrame, DataFrame]]:
    """n pairs: all rows before a cut, and the rows up to the next."""
    cuts = [*time_cuts(df, [k / (n + 1) for k in range(1, n + 1)], ts), float("inf")]
    for a, b in zip(cuts, cuts[1:]):
        yield df.where(_order(ts) <= a), df.where((_order(ts) > a) & (_order(ts) <= F.lit(b)))


def cross_validate(df: DataFrame, features: list[str], kind: str = "forest", n: int = 5, score: str = "f1", workers: int = 8, **params) -> list[float]:
    return _validated(df, features, kind, [params], n, score, workers)[0]


def _validated(df: DataFrame, features: list[str], kind: str, points: list[dict], n: int, score: str, workers: int) -> list[list[float]]:
    """Scores of every point on every expanding fold. df is computed once and each fold's training rows are prepared once; fits and scores run concurrently over them."""
    spark, rows = df.sparkSession, materialised(df)
    folds = concurrently(spark, [lambda a=a, b=b: (prepared(a, features), b) for a, b in expanding_folds(rows, n)], workers)
    one = lambda p, fold: metrics(predict(fitted(fold[0], features, kind, **p), fold[1])).first()[score]
    found = concurrently(spark, [lambda p=p, fold=fold: one(p, fold) for p in points for fold in folds], workers)
    return [found[k * n : (k + 1) * n] for k in range(len(points))]


def search(df: DataFrame, features: list[str], kind: str, grid: dict[str, list], draws: int | None = None, n: int = 5, score: str = "f1", seed: int = 42, workers: int = 8) -> tuple[dict, list[tuple[dict, float]]]:
    """The best of all points of the grid, or of `draws` seeded ones, by mean score over expanding folds; and every point's score."""
    points = [dict(zip(grid, v)) for v in itertools.product(*grid.values())]
    if draws and draws < len(points):
        points = random.Random(seed).sample(points, draws)
    scored = [(p, float(np.mean(v))) for p, v in zip(points, _validated(df, features, kind, points, n, score, workers))]
    return max(scored, key=lambda x: x[1])[0], scored


def sweep(train_rows: DataFrame, test_rows: DataFrame, features: list[str], kind: str, parameter: str, values: list, workers: int = 8, **params) -> list[dict]:
    """For each value of a parameter: training time (workers=1 for times that don't share the cluster), accuracy and F1 on both sets, and their gap."""
    seen, unseen = materialised(train_rows), materialised(test_rows)
    rows = prepared(seen, features)

    def one(v: Any) -> dict:
        began = time.monotonic()
        model = fitted(rows, features, kind, **params | {parameter: v})
        took = time.monotonic() - began
        a, b = (metrics(predict(model, x)).first() for x in (seen, unseen))
        return {parameter: v, "train_seconds": took, "train_accuracy": a["accuracy"], "test_accuracy": b["accuracy"], "train_f1": a["f1"], "test_f1": b["f1"], "gap": a["accuracy"] - b["accuracy"]}

    return concurrently(train_rows.sparkSession, [lambda v=v: one(v) for v in values], workers)


def train_by_regime(df: DataFrame, features: list[str], kind: str = "forest", regime: str = "regime", least: int = 20, workers: int = 8, **params) -> dict[str, PipelineModel]:
    """A model per regime that has at least `least` rows and both classes; all are fitted at once from one computed table."""
    rows = materialised(df)
    able = rows.groupBy(regime).agg(F.count("*").alias("n"), F.countDistinct("label").alias("k")).where((F.col("n") >= least) & (F.col("k") == 2)).collect()
    names = [r[regime] for r in able]
    return dict(zip(names, concurrently(df.sparkSession, [lambda v=v: train(rows.where(F.col(regime) == v), features, kind, **params) for v in names], workers)))


@dataclass
class BaggedForest:
    """Trees fitted on bootstrapped rows, and how they do on the rows that each did not see: metrics as a row, and (keys, label, probability, n_trees) per row of some bag's outside."""

    models: list[PipelineModel]
    out_of_bag: DataFrame
    metrics: Row

    def trees(self) -> list[Tree]:
        return [t for m in self.models for t in trees_of(m)[0]]


def bagged_forest(df: DataFrame, features: list[str], keys: list[str], n: int = 100, label: str = "label", seed: int = 42, workers: int = 8, **params) -> BaggedForest:
    """A forest with out-of-bag score: tree t is fitted with Poisson(1) weights drawn from a hash of the row's keys, and each row is scored by the trees that gave it weight 0.

    All trees share one prepared table and are fitted concurrently; rows are scored in one pass. keys identify a row.
    """
    whole = df.dropna(subset=[*features, label])
    assembler = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip")
    rows = materialised(assembler.transform(balanced(whole, label)).withColumns({"_label": F.col(label), "_key": F.xxhash64(F.lit(seed), *keys)}))

    def weighed(t: int) -> DataFrame:
        drawn = F.arrow_udf(lambda key: pa.array(poisson_weights(key.to_numpy(), t).astype(float)), "double")
        return rows.withColumn("_bag", drawn("_key") * F.col("_weight")).where("_bag > 0")

    one = {"numTrees": 1, "bootstrap": False, "featureSubsetStrategy": "sqrt"} | params
    made = concurrently(df.sparkSession, [lambda t=t: fitted(weighed(t), features, "forest", "_bag", **one | {"seed": seed + t}) for t in range(n)], workers)
    flat = [trees_of(m)[0][0] for m in made]
    schema = T.StructType([*rows.select(*keys, label).schema.fields, T.StructField("probability", T.DoubleType()), T.StructField("n_trees", T.LongType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = [TreeArrays(t) for t in flat]
        for b in batches:
            x = np.stack([b.column(f"_x{k}").to_numpy() for k in range(len(features))]) if b.num_rows else np.zeros((len(features), 0))
            key, total, seen = b.column("_key").to_numpy(), np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            for t, a in enumerate(arrays):
                outside = poisson_weights(key, t) == 0
                total[outside] += a.values_of(x[:, outside])
                seen += outside
            kept = np.flatnonzero(seen)
            names = [*keys, label]
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(kept)) for c in names], pa.array(total[kept] / seen[kept]), pa.array(seen[kept])], names=[*names, "probability", "n_trees"])

    wide = rows.select(*keys, label, "_key", *[F.col(f).cast("double").alias(f"_x{k}") for k, f in enumerate(features)])
    scored = materialised(wide.mapInArrow(score, schema))
    return BaggedForest(made, scored, metrics(scored.withColumn("prediction", (F.col("probability") > 0.5).cast("int")), label=label).first())


def predict_by_regime(df: DataFrame, models: dict[str, PipelineModel], default: PipelineModel | None = None, regime: str = "regime") -> DataFrame:
    """Each row scored by its regime's model, else by the default one; without it such rows are an error."""
    rest = df.where(~F.coalesce(F.col(regime).isin(*models), F.lit(False)))
    if default is None and rest.limit(1).count():
        raise ValueError("rows of a regime without a model, and no default model")
    parts = [predict(m, df.where(F.col(regime) == r)) for r, m in models.items()] + ([predict(default, rest)] if default is not None else [])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def vote(probabilities: list[str], weights: list[float] | None = None, voting: str = "soft") -> Column:
    """Soft: the weighted mean probability; hard: 1 if the weight of models above one half exceeds half, ties 0."""
    weights = weights or [1.0] * len(probabilities)
    total = sum(weights)
    if voting == "soft":
        return sum((F.col(p) * w for p, w in zip(probabilities, weights)), F.lit(0.0)) / total
    return (sum((F.when(F.col(p) >= 0.5, w).otherwise(0.0) for p, w in zip(probabilities, weights)), F.lit(0.0)) > total / 2).cast("int")


def adjusted(performance: dict[str, float], strength: float = 0.5, probability: str = "probability", regime: str = "regime") -> Column:
    """Probabilities drawn towards or away from one half by how well the regime is predicted, within 0 and 1."""
    p, factor = F.col(probability), F.lit(1.0)
    for r, v in performance.items():
        factor = F.when(F.col(regime) == r, 1 + strength * (v - 0.5) * 2).otherwise(factor)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + (p - 0.5) * factor))


def importances(model: PipelineModel) -> list[tuple[str, float]]:
    """Built-in importances (absolute coefficients for a logistic model), largest first."""
    names, last = model.stages[0].getInputCols(), model.stages[-1]
    values = np.abs(last.coefficients.toArray()) if hasattr(last, "coefficients") else last.featureImportances.toArray()
    return sorted(zip(names, map(float, values)), key=lambda x: (-x[1], x[0]))


def importances_by_regime(spark: SparkSession, models: dict[str, PipelineModel]) -> DataFrame:
    """(regime, feature, importance, rank) of every regime's model in one table."""
    rows = [(r, f, v, k) for r, m in models.items() for k, (f, v) in enumerate(importances(m), 1)]
    return spark.createDataFrame(rows, "regime string, feature string, importance double, rank int")


def with_donors(df: DataFrame, seed: int = 42, shift: int | None = None) -> DataFrame:
    """(own, donor): each row as a struct with another one, every row donor exactly once, over the whole table.

    Rows are dealt to ranges of a random key and numbered: within ranges, after the rows of the ranges before. The donor stands `shift` (default: random) places
    further on, so the rows of one range find theirs in one or two others, by a join on the place.
    """
    keyed = df.select(F.struct(*df.columns).alias("own"), F.xxhash64(F.lit(seed), F.xxhash64(*df.columns), F.rand(seed)).alias("_key"))
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Keys are uniform, so ranges of equal width hold about as many rows.
    placed = materialised(keyed.withColumn("_range", F.least(F.floor((F.col("_key") / 2.0**64 + 0.5) * ranges), F.lit(ranges - 1)).cast("long")))
    counts = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    first = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))  # a row per range
    n = placed.count()
    shift = shift if shift is not None else random.Random(seed).randrange(1, max(n, 2))
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_key")) - 1
    numbered = materialised(placed.withColumn("_within", within).join(F.broadcast(first), "_range").select("own", (F.col("_first") + F.col("_within")).alias("_place")))
    donors = numbered.select(F.col("own").alias("donor"), F.pmod(F.col("_place") - shift, F.lit(max(n, 1))).alias("_place"))
    return numbered.join(donors, "_place").select("own", "donor")


def permutation_importance(model: PipelineModel, df: DataFrame, features: list[str], repeats: int = 10, score: str = "f1", seed: int = 42) -> list[tuple[str, float, float]]:
    """(feature, mean, deviation) of the score lost when a column is permuted over the whole table. A repeat is one permutation of rows, whose values stand in for each column in turn, all in one job."""
    base = metrics(predict(model, df)).first()[score]
    lost: dict[str, list[float]] = {f: [] for f in features}
    for r in range(repeats):
        pairs = materialised(with_donors(df, seed + r))
        parts = [pairs.select("own.*", F.col(f"donor.{f}").alias("_value")).withColumn(f, F.col("_value")).drop("_value").withColumn("_feature", F.lit(f)) for f in features]
        for row in metrics(predict(model, reduce(DataFrame.unionByName, parts)), "_feature").collect():
            lost[row["_feature"]].append(base - row[score])
    return sorted(((f, float(np.mean(v)), float(np.std(v))) for f, v in lost.items()), key=lambda x: -x[1])


def _grid(df: DataFrame, features: list[str], points: int, low: float, high: float) -> dict[str, list[float]]:
    return {f: np.linspace(*ends, points).tolist() for f, ends in zip(features, df.approxQuantile(features, [low, high], 0.001))}


def _dependence(model: PipelineModel, df: DataFrame, grids: dict[str, list[float]]) -> DataFrame:
    """Trees are counted leaf by leaf (trees.dependence); other models score every row at every point."""
    last = model.stages[-1]
    if hasattr(last, "trees") or hasattr(last, "toDebugString"):
        flat, weights = trees_of(model)
        return dependence(df, flat, grids, weights, logistic="GBT" in type(last).__name__)
    every = df.drop(*grids)
    for f, g in grids.items():
        every = every.withColumn(f, F.explode(F.array(*map(F.lit, g))))
    return predict(model, every).groupBy(*grids).agg(F.avg("probability").alias("mean"), F.var_pop("probability").alias("spread"))


def partial_dependence(model: PipelineModel, df: DataFrame, feature: str, points: int = 100, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(value, mean, spread): mean and population variance of the probability with the column set to each of a few values between two percentiles."""
    return _dependence(model, df, _grid(df, [feature], points, low, high)).select(F.col(feature).alias("value"), "mean", "spread")


def partial_dependence_2d(model: PipelineModel, df: DataFrame, a: str, b: str, points: int = 50, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(a, b, mean): mean probability with two columns set to each pair of a grid between two percentiles."""
    return _dependence(model, df, _grid(df, [a, b], points, low, high)).select(a, b, "mean")


def heterogeneity(model: PipelineModel, df: DataFrame, features: list[str], points: int = 100) -> list[tuple[str, float, float]]:
    """(feature, mean spread of the rows' curves over the grid, range of the mean curve), largest spread first."""
    out = []
    for f in features:
        r = partial_dependence(model, df, f, points).agg(F.avg("spread"), F.max("mean") - F.min("mean")).first()
        out.append((f, float(r[0]), float(r[1])))
    return sorted(out, key=lambda x: -x[1])


def staged_accuracy(model: PipelineModel, df: DataFrame, label: str = "label") -> DataFrame:
    """(stage, accuracy) after each tree of a boosted model, from one pass: each row's leaf values are summed tree by tree."""
    trees, weights = trees_of(model)
    rows = df.dropna(subset=list(model.stages[0].getInputCols()))
    value = lambda t, w: F.get(F.array(*[F.lit(w * v.value) for v in t.leaves]), t.leaf())
    margins = rows.select(F.col(label).alias("_y"), F.array(*[value(t, w) for t, w in zip(trees, weights)]).alias("_v"))
    right = lambda k: F.avg(((F.aggregate(F.slice("_v", 1, k), F.lit(0.0), lambda a, x: a + x) > 0).cast("int") == F.col("_y")).cast("double"))
    one = margins.agg(F.array(*[F.struct(F.lit(k).alias("stage"), right(k).alias("accuracy")) for k in range(1, len(trees) + 1)]).alias("r"))
    return one.select(F.explode("r").alias("r")).select("r.*")


def model_for(regime: str, mapping: dict[str, str], models: dict[str, PipelineModel], default: str | None = None) -> PipelineModel:
    """The model that a regime is mapped to, else the default one."""
    name = mapping.get(regime, default)
    if name not in models:
        raise KeyError(f"no model for regime {regime!r}")
    return models[name]


def throughput(model: PipelineModel, df: DataFrame) -> dict:
    """Rows scored per second, from one pass over df."""
    began = time.monotonic()
    n = predict(model, df).agg(F.count("prediction")).first()[0]
    took = time.monotonic() - began
    return {"rows": n, "seconds": took, "rows_per_second": n / took}


def decay(predictions: DataFrame, windows: int = 5, ts: str = "ts") -> DataFrame:
    """metrics of contiguous windows of about equal size."""
    cuts = time_cuts(predictions, [k / windows for k in range(1, windows)], ts)
    number = sum(((_order(ts) > c).cast("int") for c in cuts), F.lit(0))
    return metrics(predictions.withColumn("window", number), "window")


def disturbed(df: DataFrame, features: list[str], seed: int = 42) -> dict[str, DataFrame]:
    """df as it is, with a tenth of values zeroed, with noise of 0.1, and with a twentieth of rows ten times as large."""
    of = lambda make: df.withColumns({f: make(F.col(f), k) for k, f in enumerate(features)})
    return {
        "baseline": df, "missing": of(lambda x, k: F.when(F.rand(seed + k) < 0.1, 0.0).otherwise(x)), "noise": of(lambda x, k: x + 0.1 * F.randn(seed + k)),
        "outliers": df.withColumn("_big", F.rand(seed) < 0.05).withColumns({f: F.when(F.col("_big"), F.col(f) * 10).otherwise(F.col(f)) for f in features}).drop("_big"),
    }
