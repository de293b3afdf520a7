"""Gaussian hidden Markov models fitted by distributed expectation-maximisation.

Series are cut into segments of bounded length. Every round scans the segments in parallel and returns only sums (a few
numbers per state); the driver updates the parameters from them. Decoding gives the path of the whole series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import KEYS, Keys
from .scan import Running, with_running


@dataclass
class Model:
    """Parameters on standardised columns, and the labels of the states."""

    columns: list[str]
    mean: np.ndarray
    scale: np.ndarray
    start: np.ndarray
    move: np.ndarray
    centres: np.ndarray
    spreads: np.ndarray
    labels: list[str]
    log_likelihood: float = float("nan")

    def log_density(self, x: np.ndarray) -> np.ndarray:
        out = []
        for c, s in zip(self.centres, self.spreads):
            root = np.linalg.cholesky(s)
            z = np.linalg.solve(root, (x - c).T)
            out.append(-0.5 * ((z**2).sum(0) + len(c) * np.log(2 * np.pi)) - np.log(np.diag(root)).sum())
        return np.array(out).T

    def durations(self) -> np.ndarray:
        """Expected run length of each state, 1 / (1 - p)."""
        with np.errstate(divide="ignore"):
            return 1 / (1 - np.diag(self.move))


def segmented(df: DataFrame, columns: list[str], length: int = 10_000, keys: Keys = KEYS) -> DataFrame:
    """Complete rows with the number of their segment within the symbol."""
    return with_running(df.dropna(subset=columns), {"_at": Running("count")}, keys=keys).withColumn("_segment", F.floor((F.col("_at") - 1) / length).cast("long"))


def whole_segments(batches: Iterator[pa.RecordBatch], begins: Callable[[pa.Table], np.ndarray]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows as whole segments, those of a batch together, and the numbers of their first rows. begins: which rows begin one."""
    left = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = t if left is None else pa.concat_tables([left, t])
        starts = np.flatnonzero(begins(t))
        if starts[-1]:
            yield t.slice(0, starts[-1]), starts[:-1]
        left = t.slice(starts[-1])
    if left is not None:
        yield left, np.zeros(1, int)


def listed(values: np.ndarray) -> pa.Array:
    """Rows of values as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))


def numbers(t: pa.Table, columns: list[str]) -> np.ndarray:
    return np.stack([t.column(c).to_numpy().astype(float) for c in columns], 1)


def forward_backward(m: Model, x: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior states, summed posterior moves, and log-likelihood, in scaled probabilities, of all segments of x together, which begin at starts."""
    starts = np.zeros(1, int) if starts is None else starts
    lengths = np.diff(np.append(starts, len(x)))
    order = np.argsort(-lengths, kind="stable")
    on = [starts[order[: np.searchsorted(-lengths[order], -t, "left")]] + t for t in range(lengths.max())]  # the rows t of the segments that are so long
    dens = m.log_density(x)
    top = dens.max(1)
    b = np.exp(dens - top[:, None])
    a, c = np.zeros_like(b), np.zeros(len(x))
    for t, at in enumerate(on):
        p = b[at] * (m.start if t == 0 else a[at - 1] @ m.move)
        c[at] = np.maximum(p.sum(1), 1e-300)
        a[at] = p / c[at][:, None]
    post, moves, beta = a.copy(), np.zeros_like(m.move), np.ones_like(b)
    for at in on[:0:-1]:
        w = b[at] * beta[at] / c[at][:, None]
        moves += m.move * (a[at - 1].T @ w)
        beta[at - 1] = w @ m.move.T
        post[at - 1] = a[at - 1] * beta[at - 1]
    return post / post.sum(1, keepdims=True), moves, float(np.log(c).sum() + top.sum())


def fit(df: DataFrame, columns: list[str], states: int = 3, rounds: int = 100, tolerance: float = 1e-4, length: int = 10_000, keys: Keys = KEYS) -> Model:
    """A model of all series in df; its states are labelled by the mean of the first column, from Calm over Trending to Volatile. Starts from quantiles of the first column."""
    d = len(columns)
    whole = df.agg(*[f(c) for c in columns for f in (F.avg, F.stddev_pop)], F.percentile_approx(columns[0], [(k + 0.5) / states for k in range(states)], 10_000)).first()
    mean, scale = np.array(whole[: 2 * d : 2], float), np.array([s or 1.0 for s in whole[1 : 2 * d : 2]], float)
    centres = np.zeros((states, d))
    centres[:, 0] = (np.array(whole[-1]) - mean[0]) / scale[0]
    m = Model(columns, mean, scale, np.full(states, 1 / states), np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1)), centres, np.stack([np.eye(d)] * states), [])
    rows = segmented(df, columns, length, keys).select(keys.symbol, "_segment", "_at", *columns).repartition(keys.symbol, "_segment").sortWithinPartitions(keys.symbol, "_at").cache()
    before = -np.inf
    try:
        for _ in range(rounds):
            sums = np.array(rows.mapInArrow(_expected(m, length), "k int, v double").groupBy("k").agg(F.sum("v")).orderBy("k").toPandas().iloc[:, 1])
            like, n, cuts = sums[0], sums[1], np.cumsum([states, states * states, states, states * d])
            first, moves, weight, sx, sxx = np.split(sums[2:], cuts)
            weight = np.maximum(weight, 1e-10)
            c = sx.reshape(states, d) / weight[:, None]
            cov = sxx.reshape(states, d, d) / weight[:, None, None] - c[:, :, None] * c[:, None, :]
            moves = moves.reshape(states, states) + 1e-10
            m = Model(columns, mean, scale, first / first.sum(), moves / moves.sum(1, keepdims=True), c, cov + 1e-3 * np.eye(d), [], like)
            if like - before < tolerance * n:
                break
            before = like
    finally:
        rows.unpersist()
    names = {2: ["Calm", "Volatile"], 3: ["Calm", "Trending", "Volatile"]}.get(states, [f"State {k}" for k in range(states)])
    m.labels = [names[k] for k in np.argsort(np.argsort(m.centres[:, 0]))]
    return m


def _expected(m: Model, length: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_segments(batches, lambda t: (t.column("_at").to_numpy() - 1) % length == 0):
            x = (numbers(t, m.columns) - m.mean) / m.scale
            post, moves, like = forward_backward(m, x, starts)
            v = np.concatenate([[like, len(x)], post[starts].sum(0), moves.ravel(), post.sum(0), (post.T @ x).ravel(), np.einsum("tk,ti,tj->kij", post, x, x).ravel()])
            yield pa.record_batch([pa.array(np.arange(len(v), dtype="int32")), pa.array(v)], ["k", "v"])

    return sums


def best_paths(starts: np.ndarray, best: np.ndarray, n: int, step: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray | float]], last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The best states of n rows in segments that begin at starts, all segments together, and the scores of each segment's last states.

    best: (segments, states) scores at the first rows; step: from the scores before and the numbers of the rows, the scores of (row, state before, state) and what is added by state. last: the segments' last states, else free.
    """
    lengths = np.diff(np.append(starts, n))
    order = np.argsort(-lengths, kind="stable")
    best, back, out = best.copy(), np.zeros((n, best.shape[1]), np.int64), np.zeros(n, np.int64)
    long = [order[: np.searchsorted(-lengths[order], -t, "left")] for t in range(lengths.max())]
    for t, on in enumerate(long[1:], 1):
        every, more = step(best[on], starts[on] + t)
        back[starts[on] + t] = every.argmax(1)
        best[on] = every.max(1) + more
    out[starts + lengths - 1] = best.argmax(1) if last is None else last
    for t in range(len(long) - 1, 0, -1):
        at = starts[long[t]] + t
        out[at - 1] = back[at, out[at]]
    return out, best


def viterbi(m: Model, x: np.ndarray, first: np.ndarray, last: np.ndarray | int | None = None, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The most likely states of x, the last one given or free, and the score of each last state. first: scores of the states at the first row, without its density. With starts, of all segments that begin there: first, last and the scores have a row each."""
    if starts is None:
        out, best = viterbi(m, x, first[None], None if last is None else np.array([last]), np.zeros(1, int))
        return out, best[0]
    dens, move = m.log_density(x), np.log(m.move + 1e-300)
    return best_paths(starts, first + dens[starts], len(x), lambda b, at: (b[:, :, None] + move, dens[at]), last)


def decode(df: DataFrame, m: Model, length: int = 10_000, keys: Keys = KEYS) -> DataFrame:
    """(symbol, ts, seq, state, regime) of the complete rows: the most likely path of each symbol's whole series, whatever the length of the segments that it is worked out in.

    Each segment gives the best score between every state before it and every state at its end; along a symbol's segments, a few numbers each, these give
    the state before and at the end of each segment; then each segment's own path is found between them. A task takes the segments of a batch together.
    """
    k = len(m.centres)
    rows = segmented(df, m.columns, length, keys).select(keys.symbol, keys.ts, keys.seq, "_segment", "_at", *m.columns)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (keys.symbol, keys.ts, keys.seq)}
    scaled = lambda t: (numbers(t, m.columns) - m.mean) / m.scale
    begins = lambda t: (t.column("_at").to_numpy() - 1) % length == 0
    enter = np.vstack([np.log(m.move + 1e-300), np.log(m.start + 1e-300)])  # by the state before; the last row stands for none

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_segments(batches, begins):
            x, head = scaled(t), t.take(starts).select([keys.symbol, "_segment"])
            first = head.column("_segment").to_numpy() == 0
            scores = np.zeros((len(starts), k, k))
            for i in range(1 if first.all() else k):  # a symbol's first segment has one row of scores
                scores[:, i] = viterbi(m, x, np.where(first[:, None], enter[k], enter[i]), None, starts)[1]
            yield from head.append_column("scores", listed(scores.reshape(len(starts), -1))).to_batches()

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_segments(batches, lambda t: t.column("_segment").to_numpy() == 0):
            scores = np.array(t.column("scores").combine_chunks().flatten()).reshape(-1, k, k)
            ends = best_paths(starts, scores[starts, 0], len(scores), lambda b, at: (b[:, :, None] + scores[at], 0.0))[0]
            before = np.roll(ends, 1)
            before[starts] = k
            yield from t.select([keys.symbol, "_segment"]).append_column("_before", pa.array(before, pa.int32())).append_column("_end", pa.array(ends, pa.int32())).to_batches()

    def path(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_segments(batches, begins):
            before, end = (t.column(c).to_numpy()[starts] for c in ("_before", "_end"))
            state = viterbi(m, scaled(t), enter[before], end, starts)[0]
            named = t.select(list(kinds)).append_column("state", pa.array(state, pa.int32()))
            yield from named.append_column("regime", pa.array(m.labels).take(pa.array(state))).to_batches()

    dealt = lambda d: d.repartition(keys.symbol, "_segment").sortWithinPartitions(keys.symbol, "_at")
    symbol = f"{keys.symbol} {kinds[keys.symbol]}, _segment long"
    scored = dealt(rows).mapInArrow(between, f"{symbol}, scores array<double>")
    links = scored.repartition(keys.symbol).sortWithinPartitions(keys.symbol, "_segment").mapInArrow(along, f"{symbol}, _before int, _end int")
    same = [rows[keys.symbol].eqNullSafe(F.col("_symbol")), rows["_segment"] == F.col("_number")]
    bound = rows.join(links.select(F.col(keys.symbol).alias("_symbol"), F.col("_segment").alias("_number"), "_before", "_end"), same).drop("_symbol", "_number")
    return dealt(bound).mapInArrow(path, ", ".join([*(f"{c} {t}" for c, t in kinds.items()), "state int", "regime string"]))
