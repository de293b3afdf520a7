"""Means over rows from counts by the cells between a forest's thresholds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticklane.operators import trees
from ticklane.plans import tree_queries as Q

ODD = [None, float("nan"), float("inf"), float("-inf"), -0.0, 0.0]


@pytest.mark.parametrize("kept", [16_000_000, 1200])
def test_means_by_cell_equal_means_by_row(spark, kept):
    r = np.random.default_rng(3)
    x = np.stack([r.uniform(1, 51, 2000).round(0), r.uniform(0, 0.11, 2000).round(2), r.uniform(0, 0.09, 2000)], 1).tolist()
    at = [[s.threshold for v in Q.FOREST[0].leaves for s in v.path if s.feature == k][0] for k in range(3)]
    x += [at, *[[v if i == k else 0.05 for i in range(3)] for k in range(3) for v in ODD]] * 2
    df = spark.createDataFrame(x, Q.NAMES).repartition(3)
    counts = trees.cell_counts(df, Q.FOREST, kept_bytes=kept)
    whole = sum(None not in v for v in x)
    assert counts.agg(F.sum("rows")).first()[0] == whole and counts.count() == counts.select(*Q.NAMES).distinct().count() < whole
    by_row = {(v.a, v.b): v.strength for v in trees.interaction_strength(trees.with_interactions(df, Q.FOREST), Q.NAMES).collect()}
    by_cell = {(v.a, v.b): v.strength for v in trees.interaction_strength(trees.with_interactions(counts, Q.FOREST), Q.NAMES, "rows").collect()}
    assert by_cell == pytest.approx(by_row, rel=1e-12)
    single = [{v.feature: v.importance for v in trees.shap_importance(trees.with_shap(d, Q.FOREST), Q.NAMES, n).collect()} for d, n in ((df, None), (counts, "rows"))]
    assert single[1] == pytest.approx(single[0], rel=1e-12)


def test_no_complete_rows_give_no_cells(spark):
    df = spark.createDataFrame([(None, 0.1, 0.1)], "l_quantity double, l_discount double, l_tax double")
    counts = trees.cell_counts(df, Q.FOREST)
    assert counts.count() == 0
    assert [v.strength for v in trees.interaction_strength(trees.with_interactions(counts, Q.FOREST), Q.NAMES, "rows").collect()] == [None] * 3


def test_interaction_query_works_out_a_cell_once(spark, tmp_path, monkeypatch):
    """The rows that reach Python's Shapley values don't grow with copies of the table."""
    seen, plain = [], trees.with_interactions
    monkeypatch.setattr(trees, "with_interactions", lambda df, *rest: seen.append(df.count()) or plain(df, *rest))
    for copies in (1, 3):
        rows = spark.range(4000 * copies).select((F.col("id") % 50 + 1.0).alias("l_quantity"), (F.col("id") % 11 / 100.0).alias("l_discount"), (F.col("id") % 9 / 100.0).alias("l_tax"))
        rows.write.parquet(f"{tmp_path}/{copies}/lineitem.parquet")
        assert Q.forest_interactions(spark, f"{tmp_path}/{copies}").count() == 3
    assert seen[1] < 4000 * 3 and seen[1] <= 51 * 12 * 10
