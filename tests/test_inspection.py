import numpy as np
import pytest
from pyspark.sql import functions as F

from ticklane.operators import models, trees


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(500, 3))
    y = ((x[:, 0] + 0.5 * x[:, 1] * (x[:, 2] > 0) + 0.3 * r.normal(size=500)) > 0).astype(int)
    return spark.createDataFrame([(i, *map(float, v), int(k)) for i, (v, k) in enumerate(zip(x, y))], "id long, a double, b double, c double, label int").withColumn("ts", F.timestamp_seconds("id")).repartition(3).cache()


def exploded(model, df, grids):
    every = df.drop(*grids)
    for f, g in grids.items():
        every = every.withColumn(f, F.explode(F.array(*map(F.lit, g))))
    made = models.predict(model, every).groupBy(*grids).agg(F.avg("probability").alias("mean"), F.var_pop("probability").alias("spread"))
    return {tuple(r[f] for f in grids): (r["mean"], r["spread"]) for r in made.collect()}


@pytest.mark.parametrize("kind, params", [("tree", {"maxDepth": 5}), ("forest", {"numTrees": 7, "maxDepth": 6}), ("boosting", {"maxIter": 5, "maxDepth": 3})])
def test_dependence_of_trees_equals_the_exploded_form(rows, kind, params):
    model = models.train(rows, ["a", "b", "c"], kind, **params)
    one = models.partial_dependence(model, rows, "a", 11).collect()
    expected = exploded(model, rows, {"a": sorted(r.value for r in one)})
    assert len(one) == 11 and all((r["mean"], r.spread) == pytest.approx(expected[(r.value,)], abs=1e-9) for r in one)
    two = models.partial_dependence_2d(model, rows, "b", "c", 6).collect()
    expected = exploded(model, rows, {"b": sorted({r.b for r in two}), "c": sorted({r.c for r in two})})
    assert len(two) == 36 and all(r["mean"] == pytest.approx(expected[r.b, r.c][0], abs=1e-9) for r in two)


def test_dependence_without_rows_or_splits(spark, rows):
    stump = trees.Tree.of(["a", "b"], (0.25, 3.0))
    assert [(r.a, r["mean"], r.spread) for r in trees.dependence(rows, [stump], {"a": [1.0]}).collect()] == [(1.0, 0.25, 0.0)]
    assert [r["mean"] for r in trees.dependence(rows.limit(0), [stump], {"a": [1.0]}).collect() if r["mean"] is not None] == []


def test_reference_grids_are_the_defaults(rows):
    model = models.train(rows, ["a", "b", "c"], "tree", maxDepth=3)
    assert models.partial_dependence(model, rows, "a").count() == 100 and models.partial_dependence_2d(model, rows, "a", "b").count() == 2500


@pytest.mark.parametrize("parts", [1, 5])
def test_each_row_is_donor_once_and_never_its_own(spark, parts):
    df = spark.range(777).withColumn("x", F.col("id") * 2).repartition(parts)
    pairs = [(r.own.id, r.donor.id) for r in models.with_donors(df, 3).collect()]
    assert sorted(a for a, _ in pairs) == sorted(b for _, b in pairs) == list(range(777))
    assert all(a != b for a, b in pairs)
    ahead = np.array([b for _, b in sorted(pairs)])
    assert abs(np.corrcoef(np.arange(777), ahead)[0, 1]) < 0.15
    same = spark.range(40).select(F.lit(1).alias("x"))
    assert models.with_donors(same).count() == 40 and models.with_donors(df.limit(1)).count() == 1 and models.with_donors(df.limit(0)).count() == 0


def test_permutation_importance_orders_columns(rows):
    model = models.train(rows, ["a", "b", "c"], "tree", maxDepth=4)
    noisy = rows.withColumn("c", F.col("c"))
    found = models.permutation_importance(model, noisy, ["a", "b", "c"], 3)
    assert found[0][0] == "a" and found[0][1] > 0.2 and all(d >= 0 for _, _, d in found)


def test_moments_of_windows_from_one_pass(spark):
    from ticklane.operators import reduction

    r = np.random.default_rng(4)
    x = np.c_[r.normal(1e6, 1, 600), r.normal(size=600), np.full(600, 7.0)]
    x[:, 1] += 0.5 * (x[:, 0] - 1e6)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)] + [(5, None, 1.0, 1.0)], "i long, a double, b double, c double").repartition(4)
    rows = {w.window: w for w in reduction.moments(df, list("abc"), F.col("i") % 3).collect()}
    for w in range(3):
        own = x[w::3]
        assert rows[w].n == 200 and rows[w]["mean"] == pytest.approx(own.mean(0).tolist())
        assert np.allclose(np.reshape(rows[w].products, (3, 3)), np.cov(own.T, bias=True) * 200, atol=1e-6)
    model = reduction.fit(df, list("abc"), n=2)
    values = np.sort(np.linalg.eigvalsh(np.corrcoef(x[:, :2].T)))[::-1]
    assert model.ratios == pytest.approx([values[0] / 3, 1 / 3], abs=1e-9) and [x["column"] for x in reduction.loadings(model)] == ["a", "b", "c"]
    jobs = spark.sparkContext.statusTracker()
    assert len(reduction.stability(df, ["a", "b"], "i", 5)["similarities"]) == 5 and jobs is not None


def serial_search(df, features, kind, points, n):
    from ticklane.operators.evaluate import metrics

    return [float(np.mean([metrics(models.predict(models.train(a, features, kind, **p), b)).first()["f1"] for a, b in models.expanding_folds(df, n)])) for p in points]


def test_concurrent_search_finds_what_a_serial_one_does(rows):
    grid = {"maxDepth": [2, 4], "minInstancesPerNode": [1, 20]}
    best, scored = models.search(rows, ["a", "b", "c"], "tree", grid, n=2)
    assert [s for _, s in scored] == pytest.approx(serial_search(rows, ["a", "b", "c"], "tree", [p for p, _ in scored], 2))
    assert best == max(scored, key=lambda x: x[1])[0]
    swept = models.sweep(rows, rows, ["a", "b", "c"], "tree", "maxDepth", [1, 5])
    assert [r["maxDepth"] for r in swept] == [1, 5] and swept[1]["train_accuracy"] > swept[0]["train_accuracy"]


def test_errors_of_concurrent_jobs_come_through(spark):
    assert models.concurrently(spark, [lambda k=k: spark.range(k).count() for k in range(5)], 3) == list(range(5))
    with pytest.raises(ZeroDivisionError):
        models.concurrently(spark, [lambda: 1 / 0])


def test_arrays_of_a_tree_give_its_values(rows):
    model = models.train(rows, ["a", "b", "c"], "tree", maxDepth=6, minInstancesPerNode=1)
    (tree,), _ = trees.trees_of(model)
    got = {r.id: r.probability for r in models.predict(model, rows).collect()}
    x = rows.select("id", "a", "b", "c").toPandas()
    values = trees.TreeArrays(tree).values_of(x[["a", "b", "c"]].to_numpy().T)
    assert all(got[i] == pytest.approx(v) for i, v in zip(x["id"], values))


def test_out_of_bag_score_agrees_with_a_holdout(spark):
    r = np.random.default_rng(42)
    x = r.normal(size=(6000, 4))
    y = ((x[:, 0] + x[:, 1] > 0) ^ (r.random(6000) < 0.2)).astype(int)
    df = spark.createDataFrame([(i, *map(float, v), int(k)) for i, (v, k) in enumerate(zip(x, y))], "id long, a double, b double, c double, d double, label int")
    forest = models.bagged_forest(df.where("id < 3000"), list("abcd"), ["id"], n=12, maxDepth=5)
    rest = x[3000:].T
    p = np.mean([trees.TreeArrays(t).values_of(rest) for t in forest.trees()], axis=0)
    assert len(forest.models) == 12 and abs(((p > 0.5) == y[3000:]).mean() - forest.metrics["accuracy"]) < 0.02
    outside = forest.out_of_bag.agg(F.count("*").alias("n"), F.avg("n_trees").alias("t")).first()
    assert outside.n > 2900 and abs(outside.t / 12 - 0.368) < 0.02


def test_models_side_by_side(spark, rows):
    from ticklane.operators import evaluate

    df = rows.select("id", "label", F.col("label").alias("p"), (F.col("a") > 0).cast("int").alias("q"))
    got = evaluate.compared_models(df, {"perfect": "p", "sign": "q"}, ["id"], rounds=50).collect()
    assert [r.model for r in got] == ["perfect", "sign"] and got[0].f1 == 1.0 and got[0].p_value is None and got[1].low > 0 and got[1].p_value == 0
    table = models.importances_by_regime(spark, models.train_by_regime(rows.withColumn("regime", F.when(F.col("id") % 2 == 0, "x").otherwise("y")), ["a", "b", "c"], "tree", maxDepth=3))
    assert {(r.regime, r["rank"]) for r in table.collect()} == {(r, k) for r in "xy" for k in (1, 2, 3)}


def test_events_in_bursts(spark):
    from ticklane.operators import hawkes

    at = lambda rows, schema: spark.createDataFrame(rows, schema)
    events = at([("a", t, t) for t in range(10)] + [("b", 3, 0)], "symbol string, t long, seq long").selectExpr("symbol", "timestamp_seconds(t) as ts", "seq")
    windows = at([("a", 2, 4, True), ("a", 3, 6, True), ("a", 8, 9, False)], "symbol string, s long, e long, is_burst boolean").selectExpr("symbol", "timestamp_seconds(s) as start", "timestamp_seconds(e) as end", "is_burst")
    got = {(r.symbol, r.seq): r.is_burst for r in hawkes.in_bursts(events, windows).collect()}
    assert got == {("a", t): 2 <= t <= 6 for t in range(10)} | {("b", 0): False}
