"""Quality classifier: histogram gradient-boosted trees over document statistics.

Spark computes the statistics of every text. The trees are fitted on at most `sample` labelled documents (a documented
bound; chosen by hash, so the same rows each time), on histograms of binned statistics, and flattened into arrays of
features, thresholds and leaf values that numpy walks for a batch of documents at once.

Rows: one output row per input row. Null texts count as empty ones and are scored like any other text. Repeated rows get
equal scores. Very long texts are measured whole. Null or repeated label rows: null labels are left out; a document labelled twice
counts once, as the lower label, and one id of several texts as the text with the least statistics. Ties between equally
good splits go to the first statistic and the lowest threshold. An empty table gives an empty result. With no labels or labels of one kind only, the score is constant. Input columns named like an output are replaced.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, bucket_of, extend, texts_of
from .textstats import code_points, duplicate_lines, numbered, repeated_words, symbol_count

STATISTICS = (
    "log_words", "chars_per_word", "word_length_deviation", "symbols_per_word", "exclamations_per_word", "bars_per_word", "digits_share", "upper_share",
    "punctuation_share", "non_ascii_share", "duplicate_lines_share", "log_lines", "words_per_line", "distinct_words_share", "top_word_share",
    "repeated_windows_share", "same_neighbours_share", "capitalised_share", "sentence_ends_share", "byte_entropy", "squeezed_share", "shortest_half_share",
)
_UPPER, _DIGITS, _PUNCTUATION = bytes(range(65, 91)), b"0123456789", bytes(x for x in range(33, 127) if not chr(x).isalnum())
_keep = lambda kept: bytes(x for x in range(256) if x not in kept)
_NOT_UPPER, _NOT_DIGITS, _NOT_PUNCTUATION = map(_keep, (_UPPER, _DIGITS, _PUNCTUATION))


def statistics(data: bytes) -> list[float]:
    """The STATISTICS of one text; all 0 without words."""
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    ids = numbered(words)[1]
    counts = np.bincount(ids)
    lengths = np.fromiter(map(len, words), np.int64, n)
    repeated, lines = duplicate_lines(data)
    size, chars = len(data), code_points(data)
    share = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / size
    share = share[share > 0]
    return [
        np.log1p(n), chars / n, lengths.std(), symbol_count(data) / n, data.count(b"!") / n, data.count(b"|") / n, len(data.translate(None, _NOT_DIGITS)) / size, len(data.translate(None, _NOT_UPPER)) / size,
        len(data.translate(None, _NOT_PUNCTUATION)) / size, (chars != size) * (size - chars) / size, repeated / max(1, lines), np.log1p(lines), n / max(1, lines), len(counts) / n, counts.max() / n,
        repeated_words(ids) / n, float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0, sum(w[:1].isupper() for w in words) / n, sum(w[-1] in b".?" for w in words) / n,
        float(-(share * np.log2(share)).sum()), len(zlib.compress(data, 1)) / size, float((lengths <= 3).mean()),
    ]


def with_statistics(docs: DataFrame, text: str = "text", name: str = "statistics") -> DataFrame:
    """docs with the STATISTICS of each whole text as array<double>."""

    def start():
        width = len(STATISTICS)

        def batch(texts: pa.Array) -> pa.Array:
            rows = [statistics(t or b"") for t in texts_of(texts)]
            return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * width, pa.int32()), pa.array(np.array(rows, float).ravel()))

        return batch

    return extend(docs, **{name: arrow_column(start, "array<double>")(F.col(text))})


@dataclass
class Trees:
    """Full binary trees of one depth: inner nodes level by level (feature, threshold), then leaves. Children of node i: 2i+1 (value <= threshold) and 2i+2."""

    base: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = (1 << self.depth) - 1
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 64, ridge: float = 2.0, least: float = 4.0) -> Trees:
    """Logistic gradient boosting; splits are sought on histograms of at most `bins` bins per feature."""
    inner = (1 << depth) - 1
    if not len(y) or y.min() == y.max():
        odds = 0.0 if not len(y) else 6.0 * (2 * float(y[0]) - 1)
        return Trees(odds, depth, *(np.zeros((0, inner), t) for t in (np.int64, float)), np.zeros((0, inner + 1)))
    n, width = x.shape
    edges = np.full((width, bins - 1), np.inf)
    for f in range(width):
        cuts = np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
        edges[f, : len(cuts)] = cuts
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], 1)  # bin k: at most edges[k]
    base = float(np.log(y.mean() / (1 - y.mean())))
    total = np.full(n, base)
    flat = binned + np.arange(width) * bins
    features, thresholds, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, weight = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            cells = ((node - first)[:, None] * (width * bins) + flat).ravel()
            g, h = (np.bincount(cells, np.repeat(v, width), count * width * bins).reshape(count, width, bins).cumsum(2) for v in (gradient, weight))
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
            gain = np.where((h >= least) & (all_h - h >= least), gain, 0)[:, :, : bins - 1].reshape(count, -1)
            best = gain.argmax(1)
            good = gain[np.arange(count), best] > 1e-9
            f, k = best // (bins - 1), best % (bins - 1)
            features[t, first : first + count] = f
            thresholds[t, first : first + count] = np.where(good, edges[f, k], np.inf)
            at = node - first
            node = 2 * node + 1 + (x[np.arange(n), f[at]] > thresholds[t, node])
        at = node - inner
        leaves[t] = rate * np.bincount(at, gradient, inner + 1) / (np.bincount(at, weight, inner + 1) + ridge)
        total += leaves[t][at]
    return Trees(base, depth, features, thresholds, leaves)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 16_384, folds: int = 5, held_out: int = 0) -> Trees:
    """Trees from the documents whose label may be learned: those with crc32(doc_id) mod folds other than held_out. At most `sample` of them, chosen by hash, are used; that bound also bounds what is broadcast and what comes to the driver."""
    may = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (bucket_of(F.col("doc_id"), folds) != held_out))
    chosen = may.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = with_statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("statistics").alias("statistics"))
    rows = found.toPandas().sort_values("doc_id")
    x = np.stack(rows["statistics"].to_numpy()) if len(rows) else np.zeros((0, len(STATISTICS)))
    return fit_trees(x, rows["quality"].to_numpy(float))


def score(docs: DataFrame, trees: Trees, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the probability that each whole text is of label 1."""

    def start():
        def batch(texts: pa.Array) -> pa.Array:
            rows = np.array([statistics(t or b"") for t in texts_of(texts)], float).reshape(-1, len(STATISTICS))
            return pa.array(trees.score(rows))

        return batch

    return extend(docs, **{name: arrow_column(start, "double")(F.col(text))})
