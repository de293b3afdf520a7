import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticklane.operators import evaluate, filters, hawkes, hmm, models, order_stats, reduction, store, trees


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(600, 3))
    y = ((x[:, 0] + 0.5 * x[:, 1] * (x[:, 2] > 0) + 0.3 * r.normal(size=600)) > 0).astype(int)
    return spark.createDataFrame([(i, *map(float, v), int(k)) for i, (v, k) in enumerate(zip(x, y))], "id long, a double, b double, c double, label int").cache()


@pytest.mark.parametrize("kind, params", [("tree", {"maxDepth": 4}), ("forest", {"numTrees": 5, "maxDepth": 4}), ("boosting", {"maxIter": 6, "maxDepth": 3})])
def test_shapley_values_sum_to_the_prediction(rows, kind, params):
    model = models.train(rows, ["a", "b", "c"], kind, **params)
    flat, weights = trees.trees_of(model)
    valued = trees.with_interactions(trees.with_shap(models.predict(model, rows), flat, weights), flat, weights)
    for r in valued.limit(100).collect():
        p = r.probability if kind != "boosting" else 0.5 * math.log(r.probability / (1 - r.probability))
        assert r.shap_base + sum(r.shap) == pytest.approx(p, abs=1e-6)
        matrix = np.reshape(r.shap_interactions, (3, 3))
        assert np.allclose(matrix, matrix.T) and np.allclose(matrix.sum(1), r.shap)
    names = {r.feature: r.importance for r in trees.shap_importance(valued, ["a", "b", "c"]).collect()}
    assert names["a"] == max(names.values())
    assert trees.interaction_strength(valued, ["a", "b", "c"]).count() == 3


def test_shapley_values_equal_all_orders():
    tree = trees.Tree.of(["a", "b", "c"], ("a", 0.0, ("b", 1.0, (0.1, 5), ("a", -1.0, (0.9, 2), (0.3, 3))), ("c", 0.5, (0.7, 8), (0.2, 4))))
    x = np.array([[-2.0, 2.0, 0.0], [-0.5, 2.0, 1.0], [1.0, 0.0, 0.2]])

    def value(row, known):
        return sum(v.value * math.prod(float((row[s.feature] <= s.threshold) == s.left) if s.feature in known else s.share for s in v.path) for v in tree.leaves)

    for row, got in zip(x, trees.shap(tree, x)):
        expected = np.zeros(3)
        for order in itertools.permutations(range(3)):
            for k in range(3):
                expected[order[k]] += (value(row, set(order[: k + 1])) - value(row, set(order[:k]))) / 6
        assert got == pytest.approx(expected)


def test_paths_rules_and_leaves(rows):
    model = models.train(rows, ["a", "b", "c"], "tree", maxDepth=3)
    (tree,), _ = trees.trees_of(model)
    paths = trees.decision_paths(models.predict(model, rows), tree).collect()
    assert all(abs(r.value - r.probability) < 1e-9 and r.depth == len(r.path) <= 3 for r in paths)
    assert len(tree.text()) == len(tree.leaves) and all(x.startswith("IF ") for x in tree.text())
    assert sum(n for _, n in tree.usage()) == len(tree.leaves) - 1
    gone = rows.limit(1).withColumn("a", F.lit(None).cast("double"))
    assert [r.leaf for r in trees.decision_paths(gone, trees.Tree.of(["a"], ("a", 0.0, (0, 1), (1, 1)))).collect()] == [None]
    assert trees.with_shap(gone, [tree]).count() == 0


def test_staged_accuracy_ends_at_the_model(rows):
    model = models.train(rows, ["a", "b", "c"], "boosting", maxIter=5, maxDepth=2)
    stages = {r.stage: r.accuracy for r in models.staged_accuracy(model, rows).collect()}
    assert sorted(stages) == [1, 2, 3, 4, 5]
    assert stages[5] == pytest.approx(evaluate.metrics(models.predict(model, rows)).first()["accuracy"])


def test_grids_of_two_columns_and_heterogeneity(rows):
    model = models.train(rows, ["a", "b", "c"], "tree", maxDepth=3)
    grid = models.partial_dependence_2d(model, rows, "a", "b", points=3).collect()
    assert len(grid) == 9 and all(0 <= r["mean"] <= 1 for r in grid)
    assert {f for f, _, _ in models.heterogeneity(model, rows, ["a", "c"], points=3)} == {"a", "c"}
    assert models.model_for("x", {}, {"m": model}, "m") is model
    with pytest.raises(KeyError):
        models.model_for("x", {}, {"m": model})


def test_models_are_stored_with_metadata(spark, rows, tmp_path):
    components = reduction.fit(rows, ["a", "b", "c"])
    store.save(spark, components, f"{tmp_path}/pca", rows=600)
    back, about = store.load(spark, reduction.Components, f"{tmp_path}/pca")
    assert back.columns == components.columns and np.array_equal(back.loadings, components.loadings) and about == {"rows": 600}
    store.save(spark, hawkes.Parameters(0.5, 0.2, 0.8), f"{tmp_path}/hawkes")
    assert store.load(spark, hawkes.Parameters, f"{tmp_path}/hawkes")[0].branching_ratio == 0.25
    with pytest.raises(ValueError):
        store.load(spark, hmm.Model, f"{tmp_path}/hawkes")
    model = models.train(rows, ["a", "b"], "logistic")
    store.save_pipeline(spark, model, f"{tmp_path}/lr", note="x")
    again, about = store.load_pipeline(spark, f"{tmp_path}/lr")
    assert about == {"features": ["a", "b"], "learner": "LogisticRegressionModel", "note": "x"}
    assert models.predict(again, rows).exceptAll(models.predict(model, rows)).count() == 0


def test_percentiles_and_ranks_with_ties_nulls_and_few_rows(spark):
    r = np.random.default_rng(1)
    data = [("a", float(v)) for v in r.integers(0, 40, 700)] + [("b", 3.0), ("b", None), ("c", None)] + [("d", float(v)) for v in r.normal(size=301)]
    df = spark.createDataFrame(data, "g string, x double")
    got = {row.g: (row.low, row.mid, row.high, row.n_unique) for row in order_stats.percentiles(df, "x", {"low": 0.01, "mid": 0.5, "high": 0.99}, ["g"]).collect()}
    for g in "abd":
        x = np.array([v for k, v in data if k == g and v is not None])
        assert got[g] == pytest.approx((*np.percentile(x, [1, 50, 99]), len(set(x.tolist()))))
    assert "c" not in got
    ranks = order_stats.mean_ranks(spark.createDataFrame([(v,) for v in (5.0, 1.0, 5.0, None)], "x double"), "x").collect()
    assert sorted((row.x for row in ranks), key=str) == [1.0, 2.5, 2.5, None]


def test_bootstraps_do_not_depend_on_partitions(rows):
    df = rows.select("id", "label", F.col("label").alias("p"), (F.col("a") > 0).cast("int").alias("q"), (F.col("a") / 100).alias("net_return"))
    one, other = (evaluate.bootstrap_difference(x, "p", "q", ["id"], score="f1", rounds=50).first() for x in (df.coalesce(1), df.repartition(7)))
    assert tuple(one) == pytest.approx(tuple(other)) and one.low <= one.difference <= one.high and one.p_value == 0
    s = evaluate.bootstrap_sharpe(df.where("label = 1"), df.where("label = 0"), ["id"], rounds=50).first()
    assert s.difference > 0 and s.low <= s.high


def test_important_columns(spark, rows):
    table = spark.createDataFrame([("a", 0.5), ("b", 0.001)], "feature string, importance double")
    assert filters.important(rows, table, ["a", "b", "c"]).columns == ["id", "a", "label"]


def grown(depth, r, features):
    """A tree whose paths ask for the same features again, with branches of any weight."""
    if depth == 0 or (depth < 4 and r.random() < 0.2):
        return (float(r.normal()), float(r.integers(1, 50)))
    return (int(r.integers(features)), float(r.normal()), grown(depth - 1, r, features), grown(depth - 1, r, features))


@pytest.mark.parametrize("depth, features", [(1, 1), (3, 2), (6, 4), (9, 5)])
def test_shapley_values_and_interactions_of_deep_trees_equal_all_subsets(depth, features):
    r = np.random.default_rng(depth)
    tree = trees.Tree.of([f"f{i}" for i in range(features)], grown(depth, r, features))
    x = r.normal(size=(7, features))
    sets = [frozenset(c) for k in range(features + 1) for c in itertools.combinations(range(features), k)]
    value = {}
    for known in sets:
        parts = [v.value * math.prod(s.share for s in v.path if s.feature not in known) * np.prod([(x[:, s.feature] <= s.threshold) == s.left for s in v.path if s.feature in known] or [np.ones(len(x))], axis=0) for v in tree.leaves]
        value[known] = np.sum(parts, axis=0)
    f = math.factorial
    weight = lambda n, taken: f(n) * f(features - n - taken) / f(features - taken + 1)
    single = np.stack([sum(weight(len(s), 1) * (value[s | {i}] - value[s]) for s in sets if i not in s) for i in range(features)], 1)
    assert np.allclose(trees.shap(tree, x), single)
    pairs = trees.shap_interactions(tree, x)
    for i, j in itertools.permutations(range(features), 2):
        expected = sum(weight(len(s), 2) / 2 * (value[s | {i, j}] - value[s | {i}] - value[s | {j}] + value[s]) for s in sets if i not in s and j not in s)
        assert np.allclose(pairs[:, i, j], expected)
    assert np.allclose(pairs.sum(2), single)
