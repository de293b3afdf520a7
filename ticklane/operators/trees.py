"""Decision paths, rules and Shapley values of Spark ML trees, tree ensembles included.

A fitted tree is small and is flattened on the driver; rows stay where they are. The leaf of a row is a nested condition that
Catalyst compiles; Shapley values come from one Arrow function over all rows. Values are the probability of class 1 for
trees and forests and the margin for boosting.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Split:
    """A condition on a path: feature <= threshold (left) or > threshold, and the share of its parent's training weight."""

    feature: int
    threshold: float
    left: bool
    share: float

    def rule(self, names: list[str]) -> str:
        return f"{names[self.feature]} {'<=' if self.left else '>'} {self.threshold:g}"


@dataclass(frozen=True)
class Leaf:
    number: int
    path: tuple[Split, ...]
    value: float
    weight: float


@dataclass
class Tree:
    """Leaves in order from left to right, each with its whole path."""

    names: list[str]
    leaves: list[Leaf]

    @classmethod
    def of(cls, names: list[str], node: tuple) -> Tree:
        """From nested tuples: (feature, threshold, left, right) or a leaf (value, weight)."""
        leaves: list[Leaf] = []

        def weight(n: tuple) -> float:
            return n[1] if len(n) == 2 else weight(n[2]) + weight(n[3])

        def walk(n: tuple, path: tuple[Split, ...]) -> None:
            if len(n) == 2:
                leaves.append(Leaf(len(leaves), path, float(n[0]), float(n[1])))
                return
            whole = weight(n)
            for left, child in ((True, n[2]), (False, n[3])):
                walk(child, (*path, Split(names.index(n[0]) if isinstance(n[0], str) else n[0], float(n[1]), left, weight(child) / whole if whole else 0.0)))

        walk(node, ())
        return cls(names, leaves)

    def leaf(self) -> Column:
        """The number of a row's leaf; null where a feature that is asked for is null."""

        def pick(leaves: list[Leaf], depth: int) -> Column:
            if len(leaves) == 1 and len(leaves[0].path) == depth:
                return F.lit(leaves[0].number)
            split = leaves[0].path[depth]
            x = F.col(names[split.feature])
            sides = ([v for v in leaves if v.path[depth].left], [v for v in leaves if not v.path[depth].left])
            return F.when(x <= split.threshold, pick(sides[0], depth + 1)).when(x > split.threshold, pick(sides[1], depth + 1))

        names = self.names
        return pick(self.leaves, 0)

    def rules(self, leaf: Leaf) -> list[str]:
        return [s.rule(self.names) for s in leaf.path]

    def text(self, classes: tuple[str, str] = ("0", "1")) -> list[str]:
        """One IF ... THEN line per leaf."""
        return [f"IF {' AND '.join(self.rules(v)) or 'TRUE'} THEN {classes[v.value >= 0.5]} ({v.value:.4f})" for v in self.leaves]

    def usage(self) -> list[tuple[str, int]]:
        """How many splits ask for each feature, most first."""
        splits = {tuple((s.feature, s.threshold, s.left) for s in v.path[:k]) + (v.path[k].feature,) for v in self.leaves for k in range(len(v.path))}
        counts = [(n, sum(s[-1] == i for s in splits)) for i, n in enumerate(self.names)]
        return sorted((x for x in counts if x[1]), key=lambda x: (-x[1], x[0]))

    def base(self) -> float:
        """The mean value over the training rows."""
        return sum(v.value * math.prod(s.share for s in v.path) for v in self.leaves)


class TreeArrays:
    """A tree as arrays of nodes, for the values of many rows at once: all rows go down a level together."""

    def __init__(self, tree: Tree):
        feature, threshold, left, right, value = [], [], [], [], []

        def put(leaves: list[Leaf], depth: int) -> int:
            at = len(feature)
            end = len(leaves[0].path) == depth
            split = None if end else leaves[0].path[depth]
            for x, v in ((feature, 0 if end else split.feature), (threshold, 0.0 if end else split.threshold), (left, at), (right, at), (value, leaves[0].value if end else 0.0)):
                x.append(v)
            if not end:
                left[at] = put([v for v in leaves if v.path[depth].left], depth + 1)
                right[at] = put([v for v in leaves if not v.path[depth].left], depth + 1)
            return at

        put(tree.leaves, 0)
        self.depth = max(len(v.path) for v in tree.leaves)
        self.feature, self.threshold, self.left, self.right, self.value = map(np.array, (feature, threshold, left, right, value))

    def values_of(self, x: np.ndarray) -> np.ndarray:
        """x: (features, rows) without missing values."""
        at, rows = np.zeros(x.shape[1], int), np.arange(x.shape[1])
        for _ in range(self.depth):
            at = np.where(x[self.feature[at], rows] <= self.threshold[at], self.left[at], self.right[at])
        return self.value[at]


def trees_of(model) -> tuple[list[Tree], list[float]]:
    """The trees of a fitted pipeline (assembler, tree model) and their weights."""
    names, last = list(model.stages[0].getInputCols()), model.stages[-1]
    parts = list(last.trees) if hasattr(last, "trees") else [last]
    boosted = "GBT" in type(last).__name__

    def nested(n) -> tuple:
        if n.subtreeDepth() == 0:
            stats = n.impurityStats()
            weights = list(stats.stats())
            return (n.prediction() if boosted else (weights[1] / sum(weights) if sum(weights) else 0.0), weights[0] if boosted else sum(weights))
        return n.split().featureIndex(), n.split().threshold(), nested(n.leftChild()), nested(n.rightChild())

    trees = [Tree.of(names, nested(t._java_obj.rootNode())) for t in parts]
    return trees, list(last.treeWeights) if boosted else [1 / len(trees)] * len(trees)


def value_of(trees: list[Tree], weights: list[float] | None = None) -> Column:
    """The ensemble's value of a row as an expression, null where a feature that is asked for is null."""
    weights = weights or [1 / len(trees)] * len(trees)
    leaf = lambda t: F.get(F.array(*[F.lit(v.value) for v in t.leaves]), t.leaf())
    return sum((leaf(t) * w for t, w in zip(trees, weights)), F.lit(0.0))


def decision_paths(df: DataFrame, tree: Tree) -> DataFrame:
    """df with leaf, value, path (its rules in order) and depth. A row of missing features gets nulls."""
    table = F.array(*[F.struct(F.lit(v.value).alias("value"), F.array(*map(F.lit, tree.rules(v))).cast("array<string>").alias("path")) for v in tree.leaves])
    rows = df.withColumn("leaf", tree.leaf())
    return rows.withColumn("_l", F.get(table, F.col("leaf"))).withColumns({"value": F.col("_l.value"), "path": F.col("_l.path"), "depth": F.size("_l.path")}).drop("_l")


def similar_paths(paths: DataFrame, reference: list[str], least: float = 0.5) -> DataFrame:
    """Rows whose rules are like the reference's: their Jaccard similarity and the rules in common."""
    ref = F.array(*map(F.lit, reference)).cast("array<string>")
    common, every = F.array_intersect("path", ref), F.array_union("path", ref)
    similarity = F.coalesce(F.try_divide(F.size(common).cast("double"), F.size(every).cast("double")), F.lit(0.0))
    return paths.withColumns({"similarity": similarity, "common_rules": common}).where(F.col("similarity") >= least)


def depth_statistics(paths: DataFrame) -> DataFrame:
    """One row: mean, median, deviation (population), least and greatest depth over rows. Depths are few, so the median's table is small."""
    d = F.col("depth")
    return paths.agg(F.avg(d).alias("mean_depth"), F.percentile(d, F.lit(0.5)).alias("median_depth"), F.stddev_pop(d).alias("std_depth"), F.min(d).alias("min_depth"), F.max(d).alias("max_depth"))


def leaf_statistics(paths: DataFrame, label: str = "label") -> DataFrame:
    """Per leaf: rows, share, predicted class and accuracy."""
    counts = paths.where("leaf is not null").groupBy("leaf").agg(F.count("*").alias("n"), F.first("value").alias("value"), F.avg(((F.col("value") >= 0.5).cast("int") == F.col(label)).cast("double")).alias("accuracy"))
    total = counts.agg(F.sum("n").alias("_total"))  # leaves are few
    return counts.join(F.broadcast(total), F.lit(True)).select("leaf", "n", (F.col("n") / F.col("_total")).alias("share"), (F.col("value") >= 0.5).cast("int").alias("predicted"), "accuracy")


@dataclass
class _Level:
    """The branches that leave one level of a tree, as arrays: two in a row per split.

    parent: the branch above (-1 at the root); above: the nearest branch above that asks for the same feature, or -1; value: of the leaf
    that the branch ends at, else 0; ends: whether it ends at one. ratios and gains are (branch, point, state) and (branch, state, point), changes
    (branch, met, point).
    """

    first: int
    parent: np.ndarray
    above: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    ends: np.ndarray
    ratios: np.ndarray
    gains: np.ndarray
    changes: np.ndarray


class ShapleyPlan:
    """Shapley values of one tree for blocks of rows, in one pass down and up its levels.

    A leaf counts with the product over its path's features of met * t + share * (1 - t), and the weights of subset sizes are integrals
    over t from 0 to 1 of such products without the features asked for. They are polynomials, so a few Gauss-Legendre points give them
    exactly. The product is carried down, one factor changed per branch; leaf values times products are summed upwards, so all leaves
    below a branch share its work, and a level is a few products of matrices.
    """

    def __init__(self, tree: Tree):
        self.width, self.root = len(tree.names), tree.leaves[0].value if not tree.leaves[0].path else None
        most = max(len({s.feature for s in v.path}) for v in tree.leaves)
        points, weights = np.polynomial.legendre.leggauss(max(1, (most + 1) // 2))
        self.t, w = (points + 1) / 2, weights / 2
        self.levels: list[_Level] = []
        open_: list[tuple[list[Leaf], int, dict[int, tuple[int, float]]]] = [] if self.root is not None else [(tree.leaves, -1, {})]
        depth = count = 0
        while open_:
            rows, following = [], []
            for leaves, parent, path in open_:
                for side in (True, False):
                    own = [v for v in leaves if v.path[depth].left == side]
                    split = own[0].path[depth]
                    above, before = path.get(split.feature, (-1, 1.0))
                    share, number = before * split.share, count + len(rows)
                    end = len(own[0].path) == depth + 1
                    rows.append((parent, above, split.feature, split.threshold, side, own[0].value if end else 0.0, end, *self.tables(w, before, share, split.share, above >= 0)))
                    if not end:
                        following.append((own, number, path | {split.feature: (number, share)}))
            columns = [np.array(x) for x in zip(*rows)]
            self.levels.append(_Level(count, *columns))
            open_, depth, count = following, depth + 1, count + len(rows)
        self.count = count
        self.features = np.concatenate([v.feature for v in self.levels]) if self.levels else np.zeros(0, int)
        parents = np.concatenate([v.parent for v in self.levels]) if self.levels else np.zeros(0, int)
        # Per level: pairs of a branch and the nearest branch above it of each other feature.
        self.pairs = []
        for v in self.levels:
            found = []
            for k in range(len(v.parent)):
                seen, up = {v.feature[k]}, v.parent[k]
                while up >= 0:
                    if self.features[up] not in seen:
                        seen.add(self.features[up])
                        found.append((k, up))
                    up = parents[up]
            self.pairs.append(np.array(found, int).reshape(-1, 2))
        self.all_changes = np.concatenate([v.changes for v in self.levels]) if self.levels else None

    def tables(self, w: np.ndarray, before: float, share: float, own: float, again: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For rows that met the feature's conditions above and now fail (0) or still meet (1), and that had failed before (2): how the factor changes, and what the feature's part of the Shapley values gains."""
        t = self.t
        held = before + (1 - before) * t if again else np.ones_like(t)
        ratios = np.stack([share * (1 - t) / held, (share + (1 - share) * t) / held, np.full_like(t, own)], 1)
        failing, meeting = -1 / (1 - t), (1 - share) / (share + (1 - share) * t)
        was = (1 - before) / held if again else np.zeros_like(t)
        return ratios, w * np.stack([failing - was, meeting - was, np.zeros_like(t)]), np.stack([failing, meeting])

    def values(self, x: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(features, rows) Shapley values, and (features, features, rows) interaction values without the diagonal."""
        n = len(x)
        single = np.zeros((self.width, n))
        double = np.zeros((self.width * self.width, n)) if pairs else None
        if not self.levels or not n:
            return single, None if double is None else double.reshape(self.width, self.width, n)
        met, states, ended = np.zeros((self.count, n), bool), [], []
        product = np.ones((1, len(self.t), n))
        for v in self.levels:
            own = (x.T[v.feature] <= v.threshold[:, None]) == v.left[:, None]
            before = np.where((v.above >= 0)[:, None], met[v.above], True)
            met[v.first : v.first + len(own)] = own & before
            state = np.stack([before & ~own, before & own, ~before], 1).astype(float)
            product = np.repeat(product, 2, axis=0)
            product *= v.ratios @ state
            states.append(state)
            ended.append(product[v.ends] * v.value[v.ends, None, None])
            product = product[~v.ends]
        sums = None
        for v, state, leaves, near in zip(self.levels[::-1], states[::-1], ended[::-1], self.pairs[::-1]):
            below = np.empty((len(v.ends), len(self.t), n))
            below[v.ends] = leaves
            if sums is not None:
                below[~v.ends] = sums
            single += (v.feature == np.arange(self.width)[:, None]).astype(float) @ ((v.gains @ below) * state).sum(1)
            if pairs and len(near):
                part = (v.gains.transpose(0, 2, 1) @ state) * below
                low, up = near[:, 0], near[:, 1]
                for at in range(0, len(near), 512):
                    a, b = low[at : at + 512], up[at : at + 512]
                    both = self.all_changes[b] @ part[a]
                    np.add.at(double, v.feature[a] * self.width + self.features[b], np.where(met[b], both[:, 1], both[:, 0]) / 2)
            sums = below[0::2] + below[1::2]
        if double is not None:
            double = double.reshape(self.width, self.width, n)
            double = double + double.transpose(1, 0, 2)
        return single, double


def shap(tree: Tree | ShapleyPlan, x: np.ndarray) -> np.ndarray:
    """(rows, features): Shapley values of the tree's value where absent features follow the training weights of branches."""
    plan = tree if isinstance(tree, ShapleyPlan) else ShapleyPlan(tree)
    return plan.values(x)[0].T


def shap_interactions(tree: Tree | ShapleyPlan, x: np.ndarray) -> np.ndarray:
    """(rows, features, features): Shapley interaction values; each row of a matrix sums to the feature's Shapley value."""
    plan = tree if isinstance(tree, ShapleyPlan) else ShapleyPlan(tree)
    single, double = plan.values(x, True)
    out = np.ascontiguousarray(double.transpose(2, 0, 1))
    d = range(plan.width)
    out[:, d, d] = single.T - out.sum(2)
    return out


def cuts_of(trees: list[Tree]) -> list[np.ndarray]:
    """The thresholds of each feature in order."""
    splits = {(s.feature, s.threshold) for t in trees for v in t.leaves for s in v.path}
    return [np.array(sorted(c for f, c in splits if f == k)) for k in range(len(trees[0].names))]


def cells_of(cuts: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """(rows, features): between which thresholds the rows of x lie; NaN is above all of them."""
    return np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T)], 1).astype(np.int32)


def distinct_cells(cuts: list[np.ndarray], cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each different cell is first, and each row's place among them."""
    first, place = np.zeros(0, np.int64), np.zeros(len(cells), np.int64)
    for c, v in zip(cuts, cells.T):
        first, place = np.unique(place * (len(c) + 1) + v, return_index=True, return_inverse=True)[1:]
    return first, place


class CellValues:
    """Values by row of a forest that reads rows through its thresholds alone: rows between the same thresholds have the same values, which are worked out once for each such cell and kept up to a size; beyond it they are worked out again."""

    def __init__(self, trees: list[Tree], weights: list[float], of: Callable[[ShapleyPlan, np.ndarray], np.ndarray], kept_bytes: int = 32_000_000):
        self.of, self.weights, self.plans = of, weights, [*map(ShapleyPlan, trees)]
        self.cuts = cuts_of(trees)
        self.width = int(np.prod(of(self.plans[0], np.zeros((1, len(self.cuts)))).shape))
        self.most = max(1, kept_bytes // (8 * self.width))
        self.worked_out = 0
        self.clear()

    def clear(self) -> None:
        self.at, self.kept = {}, np.zeros((0, self.width))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """(rows, values) of x; NaN is above all thresholds."""
        if not len(x):
            return np.zeros((0, self.width))
        cells = cells_of(self.cuts, x)
        first, place = distinct_cells(self.cuts, cells)
        if len(self.at) > self.most:
            self.clear()
        names = [c.tobytes() for c in cells[first]]
        new = [k for k, c in enumerate(names) if c not in self.at]
        if new:
            self.at.update((names[k], len(self.kept) + i) for i, k in enumerate(new))
            self.kept = np.concatenate([self.kept, *self.block(x[first[new]])])
            self.worked_out += len(new)
        return self.kept[np.array([self.at[c] for c in names])[place]]

    def block(self, x: np.ndarray) -> Iterator[np.ndarray]:
        for at in range(0, len(x), 256):
            part = x[at : at + 256]
            yield sum(w * self.of(t, part).reshape(len(part), self.width) for t, w in zip(self.plans, self.weights))


def _values(df: DataFrame, trees: list[Tree], weights: list[float], of: Callable[[ShapleyPlan, np.ndarray], np.ndarray], name: str) -> DataFrame:
    names = trees[0].names

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        values = CellValues(trees, weights, of)
        for b in batches:
            x = np.stack([b.field(k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(names))], 1) if len(b) else np.zeros((0, len(names)))
            flat = values(x)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * values.width, pa.int32()), pa.array(flat.ravel()))

    inputs = F.struct(*[F.col(n).cast("double").alias(n) for n in names])
    whole = F.forall(F.array(*[F.col(n).isNotNull() for n in names]), lambda x: x)
    return df.where(whole).withColumn(name, F.arrow_udf(scan, "array<double>")(inputs))


def with_shap(df: DataFrame, trees: list[Tree], weights: list[float] | None = None) -> DataFrame:
    """The complete rows of df with shap, a value per feature, and shap_base; base and values sum to the ensemble's value."""
    weights = weights or [1 / len(trees)] * len(trees)
    return _values(df, trees, weights, shap, "shap").withColumn("shap_base", F.lit(float(sum(w * t.base() for t, w in zip(trees, weights)))))


def with_interactions(df: DataFrame, trees: list[Tree], weights: list[float] | None = None) -> DataFrame:
    """The complete rows of df with shap_interactions, a flat matrix of features by features."""
    return _values(df, trees, weights or [1 / len(trees)] * len(trees), shap_interactions, "shap_interactions")


def cell_counts(df: DataFrame, trees: list[Tree], rows: str = "rows", kept_bytes: int = 16_000_000) -> DataFrame:
    """(features..., rows): how many complete rows of df lie in each cell between the thresholds, which the cell's upper ends stand for (infinity above all).

    What a forest makes of a row depends on its cell alone, so means over rows are worked out once a cell, however many rows and tasks there are. A task
    counts its own cells, up to kept_bytes of them at a time, before they are added up; cells are dealt out evenly afterwards, however few they are.
    """
    names, cuts = trees[0].names, cuts_of(trees)
    most, sizes = max(1, kept_bytes // (4 * len(names))), [len(c) + 1 for c in cuts]
    few = 8 * math.prod(sizes) <= kept_bytes

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(cells: np.ndarray) -> pa.RecordBatch:
            if few:  # a count for every cell there can be, without sorting
                n = np.bincount(np.ravel_multi_index(tuple(cells.T), sizes))
                at = np.flatnonzero(n)
                cells, n = np.stack(np.unravel_index(at, sizes), 1), n[at]
            else:
                first, place = distinct_cells(cuts, cells)
                cells, n = cells[first], np.bincount(place)
            ends = [pa.array(np.append(c, np.inf)[v]) for c, v in zip(cuts, cells.T)]
            return pa.record_batch([*ends, pa.array(n)], [*names, rows])

        parts, held = [], 0
        for b in batches:
            if b.num_rows:
                parts.append(cells_of(cuts, np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1)))
                held += b.num_rows
            if held >= most:
                yield counted(np.concatenate(parts))
                parts, held = [], 0
        if held:
            yield counted(np.concatenate(parts))

    whole = F.forall(F.array(*[F.col(n).isNotNull() for n in names]), lambda x: x)
    inputs = df.where(whole).select(*[F.col(n).cast("double").alias(n) for n in names])
    counts = inputs.mapInArrow(scan, ", ".join([*(f"`{n}` double" for n in names), f"`{rows}` long"]))
    return counts.groupBy(*names).agg(F.sum(rows).alias(rows)).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _mean(x: Column, rows: str | None) -> Column:
    return F.avg(x) if rows is None else F.try_divide(F.sum(x * F.col(rows)), F.sum(rows))


def shap_importance(valued: DataFrame, names: list[str], rows: str | None = None) -> DataFrame:
    """(feature, importance): the mean absolute Shapley value. rows: a column that says how many rows each stands for (see cell_counts)."""
    one = valued.agg(*[_mean(F.abs(F.get("shap", F.lit(k))), rows).alias(f"_{k}") for k in range(len(names))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"_{k}").alias("importance")) for k, n in enumerate(names)])).alias("r")).select("r.*")


def interaction_strength(valued: DataFrame, names: list[str], rows: str | None = None) -> DataFrame:
    """(a, b, strength): the mean absolute interaction of each pair of features. rows: a column that says how many rows each stands for (see cell_counts)."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    one = valued.agg(*[_mean(F.abs(F.get("shap_interactions", F.lit(i * len(names) + j))), rows).alias(f"_{i}_{j}") for i, j in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.col(f"_{i}_{j}").alias("strength")) for i, j in pairs])).alias("r")).select("r.*")


class _Boxes:
    """A tree's leaves as boxes over grids of a few features: where on the grids a leaf holds, given that a row meets its conditions on the others."""

    def __init__(self, tree: Tree, features: list[int], grids: list[np.ndarray]):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        low, high = np.zeros((1, len(grids)), int), np.array([[len(g) for g in grids]])
        nodes, depth, values, lows, highs = [tree.leaves], 0, [], [], []
        while nodes:
            rows, following, spans = [], [], []
            for at, leaves in enumerate(nodes):
                if len(leaves[0].path) == depth:
                    rows.append((0, 0.0, True, True, True))
                    values.append(leaves[0].value)
                    spans.append((low[at], high[at], None))
                    continue
                for side in (True, False):
                    own = [v for v in leaves if v.path[depth].left == side]
                    split, a, b = own[0].path[depth], low[at].copy(), high[at].copy()
                    free = split.feature in features
                    if free:
                        k = features.index(split.feature)
                        cut = int(np.searchsorted(grids[k], split.threshold, "right"))
                        a[k], b[k] = (a[k], min(b[k], cut)) if side else (max(a[k], cut), b[k])
                    rows.append((split.feature, split.threshold, side, free, False))
                    spans.append((a, b, own))
            following = [s for s in spans if s[2] is not None]
            self.levels.append((np.array([len(n[0].path) > depth for n in nodes]), *map(np.array, zip(*rows))))
            lows += [s[0] for s in spans if s[2] is None]
            highs += [s[1] for s in spans if s[2] is None]
            nodes, depth = [s[2] for s in following], depth + 1
            low, high = (np.array([s[i] for s in following]).reshape(-1, len(grids)) for i in (0, 1))
        self.values, self.low, self.high, self.sizes = np.array(values), np.array(lows), np.array(highs), [len(g) for g in grids]

    def met(self, columns: np.ndarray) -> np.ndarray:
        """(leaves, rows): whether a row meets the conditions on the features that have no grid."""
        mask, ended = np.ones((1, columns.shape[1]), bool), []
        for splits, feature, threshold, left, free, ends in self.levels:
            mask = np.repeat(mask, np.where(splits, 2, 1), axis=0)
            mask &= free[:, None] | ends[:, None] | ((columns[feature] <= threshold[:, None]) == left[:, None])
            ended.append(mask[ends])
            mask = mask[~ends]
        return np.concatenate(ended)

    def spread(self, weights: np.ndarray) -> np.ndarray:
        """(grid..., rows): weights (leaves, rows) summed over the leaves whose box holds each grid point, by adding at the corners and summing up."""
        out = np.zeros((*[n + 1 for n in self.sizes], weights.shape[1]))
        held = (self.low < self.high).all(1)
        low, high, weights = self.low[held], self.high[held], weights[held]
        for corner in range(2 ** len(self.sizes)):
            ends = [corner >> k & 1 for k in range(len(self.sizes))]
            at = np.ravel_multi_index([(high if e else low)[:, k] for k, e in enumerate(ends)], out.shape[:-1])
            order = np.argsort(at, kind="stable")
            places, starts = np.unique(at[order], return_index=True)
            if len(places):
                out.reshape(-1, weights.shape[1])[places] += (-1) ** sum(ends) * np.add.reduceat(weights[order], starts, axis=0)
        for k in range(len(self.sizes)):
            out = np.cumsum(out, axis=k)
        return out[tuple(slice(0, n) for n in self.sizes)]


def dependence(df: DataFrame, trees: list[Tree], grids: dict[str, list[float]], weights: list[float] | None = None, logistic: bool = False) -> DataFrame:
    """(a column per grid, mean, spread): mean and population variance over the complete rows of the ensemble's value with the grid's features set to each point.

    One pass, without a row per grid point: a leaf's value holds on a box of the grid for all rows that meet its conditions on the other features. With one
    grid, or with logistic (probabilities of boosted margins), a task keeps a value per grid point for a block of rows; with more grids only the
    leaves' rows are counted, and spread is null. A task gives one row of sums.
    """
    names, weights = trees[0].names, weights or [1 / len(trees)] * len(trees)
    axes = [np.sort(np.asarray(g, float)) for g in grids.values()]
    size, per_row = int(np.prod([len(g) for g in axes])), logistic or len(axes) == 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes = [_Boxes(t, [names.index(n) for n in grids], axes) for t in trees]
        n, sums, squares = 0, np.zeros(size), np.zeros(size)
        counts = [np.zeros((len(b.values), 1)) for b in boxes]
        for batch in batches:
            whole = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) if batch.num_rows else np.zeros((len(names), 0))
            n += whole.shape[1]
            for at in range(0, whole.shape[1], 256):
                part = whole[:, at : at + 256]
                if not per_row:
                    for b, c in zip(boxes, counts):
                        c += b.met(part).sum(1, keepdims=True)
                    continue
                value = sum(w * b.spread(b.met(part) * b.values[:, None]) for w, b in zip(weights, boxes)).reshape(size, -1)
                value = 1 / (1 + np.exp(-2 * value)) if logistic else value
                sums += value.sum(1)
                squares += (value**2).sum(1)
        if not per_row:
            sums = sum(w * b.spread(c * b.values[:, None]) for w, b, c in zip(weights, boxes, counts)).ravel()
        yield pa.RecordBatch.from_pydict({"n": [n], "sums": [sums.tolist()], "squares": [squares.tolist()]})

    rows = df.select(*[F.col(c).cast("double").alias(c) for c in names]).dropna()
    sums = rows.mapInArrow(scan, "n long, sums array<double>, squares array<double>")
    each = sums.select("n", F.posexplode(F.arrays_zip("sums", "squares")).alias("k", "x")).groupBy("k").agg(F.sum("n").alias("n"), F.sum("x.sums").alias("s"), F.sum("x.squares").alias("ss"))
    mean, place, columns = F.try_divide(F.col("s"), F.col("n")), F.col("k"), []
    for name, axis in zip(reversed(grids), reversed(axes)):
        columns.insert(0, F.get(F.array(*map(F.lit, axis.tolist())), (place % len(axis)).cast("int")).alias(name))
        place = F.floor(place / len(axis))
    spread = F.greatest(F.try_divide(F.col("ss"), F.col("n")) - mean * mean, F.lit(0.0)) if per_row else F.lit(None).cast("double")
    return each.select(*columns, mean.alias("mean"), spread.alias("spread"))
