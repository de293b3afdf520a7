"""Segments of many series worked out together."""

import numpy as np
import pyarrow as pa
import pytest

from ticklane.operators import hmm

MODEL = hmm.Model(["x"], np.zeros(1), np.ones(1), np.array([0.5, 0.3, 0.2]), np.array([[0.8, 0.15, 0.05], [0.1, 0.8, 0.1], [0.05, 0.25, 0.7]]), np.array([[-1.0], [0.0], [1.0]]), np.array([[[0.5]], [[0.4]], [[0.6]]]), ["Calm", "Trending", "Volatile"])
STARTS, LENGTHS = np.array([0, 7, 8, 30]), [7, 1, 22, 5]


def test_segments_together_give_what_each_gives_alone():
    x = np.random.default_rng(8).normal(size=(35, 1))
    alone = [x[a : a + n] for a, n in zip(STARTS, LENGTHS)]
    post, moves, like = hmm.forward_backward(MODEL, x, STARTS)
    each = [hmm.forward_backward(MODEL, part) for part in alone]
    assert post == pytest.approx(np.concatenate([e[0] for e in each]))
    assert moves == pytest.approx(sum(e[1] for e in each)) and like == pytest.approx(sum(e[2] for e in each))
    first, last = np.log(MODEL.start), np.array([2, 0, 1, 1])
    for ends in (None, last):
        states, scores = hmm.viterbi(MODEL, x, np.tile(first, (4, 1)), ends, STARTS)
        each = [hmm.viterbi(MODEL, part, first, None if ends is None else ends[i]) for i, part in enumerate(alone)]
        assert list(states) == [s for e in each for s in e[0]] and scores == pytest.approx(np.array([e[1] for e in each]))


@pytest.mark.parametrize("size", [1, 3, 7, 40])
def test_batches_do_not_cut_segments(size):
    rows = pa.record_batch([pa.array([i for n in LENGTHS for i in range(n)])], ["n"])
    batches = [rows.slice(a, size) for a in range(0, 35, size)]
    found = [(t.column("n").to_pylist(), starts) for t, starts in hmm.whole_segments(iter([rows.slice(0, 0), *batches]), lambda t: t.column("n").to_numpy() == 0)]
    assert [v for values, _ in found for v in values] == rows.column(0).to_pylist()
    assert [values[s] for values, starts in found for s in starts] == [0, 0, 0, 0]
