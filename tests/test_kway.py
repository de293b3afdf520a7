import numpy as np
import pytest
from pyspark.sql import functions as F

from ticklane.operators import asof, resample


def rows(spark, n, name, seed, span=40_000):
    r = np.random.default_rng(seed)
    return spark.createDataFrame([(f"s{i % 3}", int(t), i, float(i)) for i, t in enumerate(r.integers(0, span, n))], f"symbol string, t long, seq long, {name} double").selectExpr("symbol", "timestamp_seconds(t) as ts", "seq", name)


@pytest.mark.parametrize("tolerance", [None, 500.0])
def test_all_sides_at_once_equal_a_join_per_side(spark, tolerance):
    left, one, two = rows(spark, 200, "x", 1), rows(spark, 60, "y", 2), rows(spark, 30, "z", 3)
    expected = asof.asof_join(asof.asof_join(left, one, tolerance, suffix="_one"), two, tolerance, suffix="_two")
    expected = sorted(map(str, expected.select("symbol", "seq", "x", "seq_one", "y", "seq_two", "z").collect()))
    for width in (None, 100.0, 1e6):
        got = asof.asof_join_all(left, {"one": one, "two": two}, tolerance, width=width)
        assert sorted(map(str, got.select("symbol", "seq", "x", "seq_one", "y", "seq_two", "z").collect())) == expected


def test_one_exchange_for_any_number_of_sides(spark):
    left, sides = rows(spark, 20, "x", 1), {n: rows(spark, 20, n, i) for i, n in enumerate("abc")}
    for made in (asof.asof_join_all(left, sides), asof.joined_on_time(left, sides)):
        assert made._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
        assert made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange") == 1


def test_tables_joined_on_time(spark):
    at = lambda t, **v: dict(symbol="a", ts=t, seq=0, **v)
    base = spark.createDataFrame([at(1, x=1.0), at(2, x=2.0)])
    one, two = spark.createDataFrame([at(2, y=5.0, x=7.0), at(3, y=6.0, x=8.0)]), spark.createDataFrame([at(1, z=9.0)])
    got = asof.joined_on_time(base, {"one": one, "two": two}).orderBy("ts").collect()
    assert [(r.ts, r.x, r.y, r.x_one, r.z) for r in got] == [(1, 1.0, None, None, 9.0), (2, 2.0, 5.0, 7.0, None)]


def test_long_timelines_are_dealt_out(spark):
    ends = spark.sql("select 'a' as symbol, timestamp_ntz'2024-01-01 00:00:00' as ts union all select 'a', timestamp_ntz'2024-01-01 07:00:00' union all select 'b', timestamp_ntz'2024-01-01 00:00:01'")
    got = resample.timeline(ends, 1)
    assert {(r.symbol, r.n, r.m) for r in got.groupBy("symbol").agg(F.count("*").alias("n"), F.countDistinct("ts").alias("m")).collect()} == {("a", 25_201, 25_201), ("b", 1, 1)}
