import numpy as np
import pytest
from pyspark.sql import functions as F

from ticklane.operators import asof, hawkes, hmm, models, quality, ranking, reduction, rolling


def test_hawkes_recovers_parameters():
    times = hawkes.simulate(0.5, 0.6, 1.2, 3000, seed=1)
    mu, alpha, beta = hawkes.fit(times)
    assert mu == pytest.approx(0.5, rel=0.25)
    assert alpha / beta == pytest.approx(0.5, abs=0.12)


def test_poisson_events_do_not_excite():
    mu, alpha, beta = hawkes.fit(np.sort(np.random.default_rng(2).uniform(0, 1000, 1000)))
    assert alpha / beta < 0.25


def test_hawkes_windows_cover_whole_windows(spark):
    rows = spark.range(500).selectExpr("'a' as symbol", "timestamp_millis(id * 1000 + id % 7 * 100) as ts", "id as seq")
    made = hawkes.rolling_fit(rows, 200, 100, rounds=3).orderBy("window").collect()
    assert [(r.window, r.n_events) for r in made] == [(0, 200), (1, 200), (2, 200), (3, 200)]
    few = hawkes.rolling_fit(rows.limit(60), 200, 100, rounds=3).collect()
    assert [(r.window, r.n_events) for r in few] == [(0, 60)]
    assert hawkes.rolling_fit(rows.limit(10), 200, 100).count() == 0


def test_intensity_counts_strictly_earlier_events(spark):
    rows = spark.createDataFrame([("a", 0.0, 1), ("a", 1.0, 2), ("a", 1.0, 3)], "symbol string, t double, seq long").selectExpr("symbol", "cast(t as timestamp) as ts", "seq")
    found = [r.intensity for r in hawkes.intensity(rows, 0.1, 2.0, 1.0).orderBy("seq").collect()]
    assert found == pytest.approx([0.1, 0.1 + 2 * np.exp(-1), 0.1 + 2 * np.exp(-1)])


@pytest.mark.parametrize("beta", [0.01, 1.0, 200.0, 0.0])
def test_intensity_counts_all_earlier_events(spark, beta):
    """Dense events with equal times, whose memory holds many more than 200 of them, and gaps over several buckets."""
    r = np.random.default_rng(5)
    times = {"a": np.sort(r.integers(0, 800, 1200)) / 100, "b": np.sort(np.concatenate([r.integers(0, 10**5, 300), r.integers(2 * 10**6, 3 * 10**6, 200)])) / 100, None: np.array([5.0, 6.0])}
    events = [(s, float(x), i) for s, at in times.items() for i, x in enumerate(at)]
    rows = spark.createDataFrame([*events, ("a", None, 5000)], "symbol string, t double, seq long").selectExpr("symbol", "timestamp_micros(cast(round(t * 1e6) as long)) as ts", "seq")
    made = hawkes.intensity(rows, 0.1, 2.0, beta)
    assert made.columns == ["symbol", "ts", "seq", "intensity"]
    found = {(x.symbol, x.seq): x.intensity for x in made.collect()}
    assert found.pop(("a", 5000)) == pytest.approx(0.1) and len(found) == len(events)
    for s, x, i in events:
        past = times[s][times[s] < x]
        assert found[s, i] == pytest.approx(0.1 + 2.0 * np.exp(-beta * (x - past)).sum(), rel=1e-8)


def test_hidden_states_are_found(spark):
    r = np.random.default_rng(3)
    truth = np.repeat([0, 1, 2, 1, 0, 2], 80)
    x = r.normal(np.array([0.0, 5.0, 12.0])[truth], 0.7)
    rows = spark.createDataFrame([("a", i, i, float(v)) for i, v in enumerate(x)], "symbol string, ts long, seq long, x double")
    model = hmm.fit(rows, ["x"], 3, rounds=15, length=150)
    found = [r.regime for r in hmm.decode(rows, model).orderBy("seq").collect()]
    names = np.array(["Calm", "Trending", "Volatile"])[truth]
    assert np.mean(np.array(found) == names) > 0.97
    assert (model.durations() > 10).all()


def test_components_stability_and_drift(spark):
    r = np.random.default_rng(4)
    z = r.normal(size=(600, 2))
    x = np.c_[z[:, 0], z[:, 0] + 0.05 * r.normal(size=600), z[:, 1], z[:, 1] + 0.05 * r.normal(size=600)]
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i long, a double, b double, c double, d double")
    model = reduction.fit(rows, list("abcd"), 0.9)
    values = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1]
    assert model.ratios == pytest.approx(values[:2] / 4, abs=1e-6)
    scores = np.array(model.transform(rows).orderBy("i").select("pc_1").toPandas())[:, 0]
    assert scores.std() == pytest.approx(np.sqrt(values[0]), rel=1e-3)
    assert len(reduction.stability(rows, list("abcd"), "i", 2)["similarities"]) == 2
    assert not reduction.drift(model, rows)["drift"]


@pytest.fixture(scope="module")
def labelled(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 3))
    y = (x[:, 0] + x[:, 1] > 0).astype(int)
    rows = [(i, *map(float, v), int(k), ["Calm", "Volatile"][i % 2]) for i, (v, k) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "i long, a double, b double, c double, label int, regime string").withColumn("ts", F.timestamp_seconds("i")).cache()


def test_temporal_split_folds_and_regimes(spark, labelled):
    early, late = models.temporal_split(labelled)
    assert (early.count(), late.count()) == (320, 80)
    assert early.agg(F.max("i")).first()[0] < late.agg(F.min("i")).first()[0]
    folds = [(a.count(), b.count()) for a, b in models.expanding_folds(labelled, 3)]
    assert [a for a, _ in folds] == sorted(a for a, _ in folds) and folds[0][0] + sum(b for _, b in folds) == 400
    by = models.train_by_regime(early, ["a", "b", "c"], "tree", maxDepth=4)
    scored = models.predict_by_regime(late, by)
    assert set(by) == {"Calm", "Volatile"} and scored.count() == 80
    assert scored.where("label = prediction").count() > 60
    with pytest.raises(ValueError):
        models.predict_by_regime(late, {"Calm": by["Calm"]})


def test_importance_and_dependence(spark, labelled):
    model = models.train(labelled, ["a", "b", "c"], "logistic")
    assert {n for n, _ in models.importances(model)[:2]} == {"a", "b"}
    assert models.permutation_importance(model, labelled, ["a", "b", "c"], 1)[-1][0] == "c"
    curve = models.partial_dependence(model, labelled, "a", 5).orderBy("value").collect()
    assert len(curve) == 5 and curve[0]["mean"] < curve[-1]["mean"]


def test_votes_and_adjustment(spark):
    df = spark.createDataFrame([(0.9, 0.2, "x"), (0.6, 0.6, "y")], "p double, q double, regime string")
    got = df.select(models.vote(["p", "q"], [3, 1]).alias("s"), models.vote(["p", "q"], voting="hard").alias("h"), models.adjusted({"x": 1.0}, 0.5, "p").alias("a")).collect()
    assert [(round(r.s, 6), r.h, round(r.a, 6)) for r in got] == [(0.725, 0, 1.0), (0.6, 1, 0.6)]


def test_asof_ties_tolerance_and_null_fields(spark):
    t = lambda s: f"2024-01-01 09:30:{s}"
    left = spark.createDataFrame([("a", t("00"), 1), ("a", t("02"), 2), ("a", t("05"), 3), ("b", t("02"), 4)], "symbol string, ts string, seq long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    right = spark.createDataFrame([("a", t("02"), 1, 1.0), ("a", t("02"), 2, None), ("a", t("03"), 3, 3.0)], "symbol string, ts string, seq long, bid double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    get = lambda **k: [(r.seq, r.seq_right, r.bid) for r in asof.asof_join(left, right, **k).orderBy("seq").collect()]
    assert get() == [(1, None, None), (2, 2, None), (3, 3, 3.0), (4, None, None)]
    assert get(tolerance=2.0) == get()
    assert get(tolerance=1.9)[2] == (3, None, None)
    assert get(direction="forward")[:3] == [(1, 1, 1.0), (2, 1, 1.0), (3, None, None)]
    assert get(bucket="minute") == get()


def test_moments_gaps_and_rankings(spark):
    rows = spark.createDataFrame([("a", i, i, float(v)) for i, v in enumerate((1, 2, 4, 9, 11))], "symbol string, ts long, seq long, x double").withColumn("ts", F.timestamp_seconds("ts"))
    last = rows.select("seq", rolling.rolling_skew("x", 5).alias("s"), rolling.rolling_kurtosis("x", 5).alias("k")).orderBy("seq").collect()[-1]
    assert (last.s, last.k) == (pytest.approx(0.4670455, abs=1e-6), pytest.approx(-2.4169776, abs=1e-6))
    assert quality.gaps(rows, 0.5).count() == 4
    a, b = (spark.createDataFrame(x, "feature string, importance double") for x in ([("u", 3.0), ("v", 1.0)], [("v", 1.0), ("w", 1.0)]))
    both = {r.feature: r["mean"] for r in ranking.merged_importances({"a": a, "b": b}).collect()}
    assert both == {"u": 0.375, "v": 0.375, "w": 0.25}
    assert [r.percent for r in ranking.concentration(a).collect()] == [10, 20, 50]


@pytest.mark.parametrize("length", [1, 7, 50, 10_000])
def test_decoding_does_not_depend_on_segments(spark, length):
    r = np.random.default_rng(9)
    m = hmm.Model(["x"], np.zeros(1), np.ones(1), np.array([0.6, 0.3, 0.1]), np.array([[0.8, 0.15, 0.05], [0.1, 0.8, 0.1], [0.05, 0.25, 0.7]]), np.array([[-1.0], [0.0], [1.0]]), np.full((3, 1, 1), 0.8), ["Calm", "Trending", "Volatile"])
    series = {"a": r.normal(size=120), "b": r.normal(size=30)}
    df = spark.createDataFrame([(s, i, i, float(v)) for s, x in series.items() for i, v in enumerate(x)], "symbol string, t long, seq long, x double").selectExpr("symbol", "timestamp_seconds(t) as ts", "seq", "x")
    got = {(row.symbol, row.seq): row.state for row in hmm.decode(df, m, length).collect()}
    for s, x in series.items():
        expected = hmm.viterbi(m, x[:, None], np.log(m.start + 1e-300))[0]
        assert [got[s, i] for i in range(len(x))] == expected.tolist()
    assert hmm.decode(df.limit(0), m, length).count() == 0


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_buckets_do_not_change_asof_matches(spark, direction):
    r = np.random.default_rng(12)
    rows = lambda n, name: spark.createDataFrame([(f"s{i % 3}", int(t), i, float(i)) for i, t in enumerate(r.integers(0, 40_000, n))], f"symbol string, t long, seq long, {name} double").selectExpr("symbol", "timestamp_seconds(t) as ts", "seq", name)
    left, right = rows(200, "x"), rows(30, "y")
    found = [sorted(map(str, asof.asof_join(left, right, direction=direction, bucket=b).select("symbol", "seq", "x", "y").collect())) for b in (None, "hour", "minute")]
    assert found[0] == found[1] == found[2] and len(found[0]) == 200


def test_simulated_events_do_not_depend_on_partitions_and_fit_their_parameters(spark):
    made = hawkes.simulated(spark, 0.5, 0.6, 1.2, 1000.0, series=8)
    rows = sorted(map(tuple, made.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sorted(map(tuple, hawkes.simulated(spark, 0.5, 0.6, 1.2, 1000.0, series=8).repartition(5).collect())) == rows
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    counts = np.bincount([r[0] for r in rows], minlength=8)
    # Mean mu T / (1 - n), variance of a count about mu T / (1 - n)^3.
    assert abs(counts.mean() - 1000.0) < 3 * np.sqrt(0.5 * 1000 / 0.5**3 / 8)
    born = sum(r[1] > 0 for r in rows) / len(rows)
    assert abs(born - 0.5) < 3 * np.sqrt(0.25 / len(rows)) + 0.01
    fits = [hawkes.fit(np.sort([r[2] for r in rows if r[0] == k])) for k in range(8)]
    ratios = np.array([a / b for _, a, b in fits])
    assert abs(ratios.mean() - 0.5) < 3 * ratios.std() / np.sqrt(8) + 0.03
    with pytest.raises(ValueError):
        hawkes.simulated(spark, 1.0, 2.0, 1.0, 10.0)
