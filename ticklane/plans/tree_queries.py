"""Queries on a deep fixed forest, so that SQL can value every set of known features."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trees
from . import tables as T
from .registry import near, near_sql, query, rounded, rounded_sql

NAMES = ["l_quantity", "l_discount", "l_tax"]
RANGES = ((1.0, 51.0), (0.0, 0.11), (0.0, 0.09))


def grown(depth: int, salt: int, number: int = 1, ranges: tuple = RANGES) -> tuple:
    """A tree by rule: features in turn, thresholds off the middle of what is left of their range, some branches cut short."""
    rule = (number * 37 + salt * 11) % 101
    if depth == 0 or (depth < 8 and rule % 4 == 0):
        return (rule / 100, 1.0 + rule % 7)
    f = (depth + salt + rule) % len(NAMES)
    low, high = ranges[f]
    threshold = round(low + (high - low) * (0.4 + rule % 3 / 10), 4)
    cut = lambda side: tuple(side if k == f else r for k, r in enumerate(ranges))
    return (f, threshold, grown(depth - 1, salt, 2 * number, cut((low, threshold))), grown(depth - 1, salt, 2 * number + 1, cut((threshold, high))))


NESTED = [grown(10, salt) for salt in (1, 2, 3)]
FOREST = [trees.Tree.of(NAMES, n) for n in NESTED]


def _weight(node: tuple) -> float:
    return node[1] if len(node) == 2 else _weight(node[2]) + _weight(node[3])


def _value_sql(node: tuple, known: frozenset[int]) -> str:
    """The tree's value where the known features decide and the others follow the branches' weights."""
    if len(node) == 2:
        return repr(node[0])
    left, right = (_value_sql(n, known) for n in node[2:])
    if node[0] in known:
        return f"CASE WHEN {NAMES[node[0]]} <= {node[1]!r} THEN {left} ELSE {right} END"
    share = _weight(node[2]) / _weight(node)
    return f"({share!r}::DOUBLE * {left} + {1 - share!r}::DOUBLE * {right})"


SETS = [frozenset(c) for k in range(len(NAMES) + 1) for c in combinations(range(len(NAMES)), k)]
_NAME = {s: "v" + "".join(map(str, sorted(s))) for s in SETS}
_VALUES = "w AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"({' + '.join(_value_sql(n, s) for n in NESTED)}) / {len(NESTED)}::DOUBLE AS {_NAME[s]}" for s in SETS) + " FROM lineitem)"


def _single_sql(i: int) -> str:
    n = len(NAMES)
    parts = [f"{math.factorial(len(s)) * math.factorial(n - 1 - len(s)) / math.factorial(n)!r}::DOUBLE * ({_NAME[s | {i}]} - {_NAME[s]})" for s in SETS if i not in s]
    return " + ".join(parts)


def _pair_sql(i: int, j: int) -> str:
    n = len(NAMES)
    parts = [f"{math.factorial(len(s)) * math.factorial(n - 2 - len(s)) / (2 * math.factorial(n - 1))!r}::DOUBLE * ({_NAME[s | {i, j}]} - {_NAME[s | {i}]} - {_NAME[s | {j}]} + {_NAME[s]})" for s in SETS if not {i, j} & s]
    return " + ".join(parts)


@query(f"WITH {_VALUES} SELECT l_orderkey, l_linenumber, {rounded_sql({n: _single_sql(i) for i, n in enumerate(('quantity', 'discount', 'tax'))} | {'base': 'v'})} FROM w")
def forest_shap(spark: SparkSession, sf: str) -> DataFrame:
    valued = trees.with_shap(T.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *NAMES), FOREST)
    return valued.select("l_orderkey", "l_linenumber", *rounded({n: F.get("shap", F.lit(i)) for i, n in enumerate(("quantity", "discount", "tax"))} | {"base": F.col("shap_base")}))


_PAIRS = [(i, j) for i in range(3) for j in range(i + 1, 3)]


@query(f"WITH {_VALUES} " + " UNION ALL ".join(f"SELECT '{NAMES[i]}' AS a, '{NAMES[j]}' AS b, {near_sql(f'avg(abs({_pair_sql(i, j)}))')} AS strength FROM w" for i, j in _PAIRS))
def forest_interactions(spark: SparkSession, sf: str) -> DataFrame:
    valued = trees.with_interactions(trees.cell_counts(T.read(spark, sf, "lineitem"), FOREST), FOREST)
    return trees.interaction_strength(valued, NAMES, "rows").select("a", "b", near("strength").alias("strength"))


#: Points of the dependence queries, off the thresholds.
QUANTITIES = [1.5 + 2.5 * k for k in range(20)]
DISCOUNTS, TAXES = [0.001 + 0.0085 * k for k in range(12)], [0.0007 + 0.0077 * k for k in range(10)]
_KNOWN = frozenset(range(len(NAMES)))
_FOREST_SQL = f"({' + '.join(_value_sql(n, _KNOWN) for n in NESTED)}) / {len(NESTED)}::DOUBLE"


def _points_sql(name: str, values: list[float]) -> str:
    return f"(SELECT unnest([{', '.join(f'{v!r}::DOUBLE' for v in values)}]) AS {name})"


@query(f"WITH p AS (SELECT {_FOREST_SQL} AS value, l_quantity FROM (SELECT l_discount, l_tax FROM lineitem), {_points_sql('l_quantity', QUANTITIES)}) SELECT l_quantity, {near_sql('avg(value)')} AS mean, {near_sql('var_pop(value)')} AS spread FROM p GROUP BY l_quantity")
def forest_dependence(spark: SparkSession, sf: str) -> DataFrame:
    made = trees.dependence(T.read(spark, sf, "lineitem"), FOREST, {"l_quantity": QUANTITIES})
    return made.select("l_quantity", *rounded({c: F.col(c) for c in ("mean", "spread")}))


@query(f"WITH p AS (SELECT {_FOREST_SQL} AS value, l_discount, l_tax FROM (SELECT l_quantity FROM lineitem), {_points_sql('l_discount', DISCOUNTS)}, {_points_sql('l_tax', TAXES)}) SELECT l_discount, l_tax, {near_sql('avg(value)')} AS mean FROM p GROUP BY ALL")
def forest_dependence_2d(spark: SparkSession, sf: str) -> DataFrame:
    made = trees.dependence(T.read(spark, sf, "lineitem"), FOREST, {"l_discount": DISCOUNTS, "l_tax": TAXES})
    return made.select("l_discount", "l_tax", near("mean").alias("mean"))


@query(f"SELECT l_orderkey, l_linenumber, {near_sql(_FOREST_SQL)} AS probability, CAST({_FOREST_SQL} > 0.5 AS INT) AS prediction FROM lineitem")
def forest_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the fixed forest as conditions that Catalyst compiles."""
    scored = T.read(spark, sf, "lineitem").withColumn("_p", trees.value_of(FOREST))
    return scored.select("l_orderkey", "l_linenumber", near("_p").alias("probability"), (F.col("_p") > 0.5).cast("int").alias("prediction"))
