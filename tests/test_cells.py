"""Shapley values by the cells between a forest's thresholds."""

import numpy as np
import pytest

from ticklane.operators import trees
from ticklane.plans import tree_queries as Q


@pytest.mark.parametrize("of", [trees.shap, trees.shap_interactions])
@pytest.mark.parametrize("kept", [32_000_000, 1])
def test_rows_of_a_cell_are_worked_out_once_and_equal_their_own_values(of, kept):
    r = np.random.default_rng(2)
    x = np.stack([r.integers(1, 51, 3000).astype(float), r.integers(0, 11, 3000) / 100, r.integers(0, 9, 3000) / 100], 1)
    at = [s.threshold for v in Q.FOREST[0].leaves for s in v.path if s.feature == 0][0]
    x[:4] = [[at, 0.05, 0.02], [np.nan, 0.05, 0.02], [np.inf, np.nan, 0.02], [-np.inf, 0.0, np.nan]]
    values = trees.CellValues(Q.FOREST, [0.5, 0.3, 0.2], of, kept)
    got = np.concatenate([values(x[a : a + 700]) for a in range(0, 3000, 700)])
    plans = [trees.ShapleyPlan(t) for t in Q.FOREST]
    expected = sum(w * of(p, x) for w, p in zip([0.5, 0.3, 0.2], plans)).reshape(3000, -1)
    assert got == pytest.approx(expected, abs=1e-12)
    again = values.worked_out
    values(x[2100:])
    assert kept == 1 or (again < 2500 and values.worked_out == again)
    assert values(x[:0]).shape == (0, values.width)
