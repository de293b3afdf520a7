"""As-of joins: each left row with the nearest right row in time, without a cross product.

Both sides are united, shuffled once by symbol and scanned in time order; the newest right row is carried along as a
struct, so a null in it is kept. Equal times match. Ties among right rows go to the last in order (backward) or the first
(forward); nearest prefers backward. A symbol whose rows exceed a task can be split by `bucket`, a time interval: rows are
then shuffled by (symbol, bucket) and each bucket is seeded with the last right row of earlier ones.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import seconds_between
from .keys import KEYS, Keys
from .scan import Running, with_running

_SIDE, _LEFT, _RIGHT = "_side", "_left", "_right"


def _united(left: DataFrame, right: DataFrame, keys: Keys, bucket: str | None, direction: str) -> DataFrame:
    frame = lambda df: F.struct(*[F.col(c) for c in df.columns])
    cell = [F.date_trunc(bucket, F.col(keys.ts).cast("timestamp")).alias("_bucket")] if bucket else []
    one = lambda df, side: df.select(keys.symbol, keys.ts, keys.seq, F.lit(side).alias(_SIDE), *cell, frame(df).alias(_LEFT if side else _RIGHT))
    both = one(left, 1).unionByName(one(right, 0), allowMissingColumns=True)
    if not bucket:
        return both
    # Each bucket also gets the last right row of the buckets before it, and the first one of those after it, found over one row per bucket.
    row, order = F.when(F.col(_SIDE) == 0, F.struct(keys.ts, keys.seq, _RIGHT)), Window.partitionBy(keys.symbol).orderBy("_bucket")
    ends = both.groupBy(keys.symbol, "_bucket").agg(F.max(row).alias("_last"), F.min(row).alias("_first"))
    before = F.last("_last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_first", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    wanted = {"backward": [before], "forward": [after], "nearest": [before, after]}[direction]
    near = ends.withColumns({f"_{k}": c for k, c in enumerate(wanted)})
    seeds = near.select(keys.symbol, "_bucket", F.explode(F.array(*[f"_{k}" for k in range(len(wanted))])).alias("_seed"))
    seeded = seeds.where("_seed is not null").select(keys.symbol, f"_seed.{keys.ts}", f"_seed.{keys.seq}", F.lit(0).alias(_SIDE), "_bucket", f"_seed.{_RIGHT}")
    return both.unionByName(seeded, allowMissingColumns=True)


def asof_join(left: DataFrame, right: DataFrame, tolerance: float | None = None, direction: str = "backward", suffix: str = "_right", keys: Keys = KEYS, bucket: str | None = None) -> DataFrame:
    """left with the columns of the nearest right row (null without one), the symbol left out; names that left has get suffix.

    tolerance: most seconds between the two, included. direction: backward, forward or nearest. bucket: a date_trunc unit by which a symbol is split, so that it is not one task.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"unknown direction {direction!r}")
    both = _united(left, right, keys, bucket, direction)
    groups = [keys.symbol, "_bucket"] if bucket else [keys.symbol]
    through = Window.partitionBy(*groups)
    back = F.last(_RIGHT, ignorenulls=True).over(through.orderBy(keys.ts, _SIDE, keys.seq).rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.last(_RIGHT, ignorenulls=True).over(through.orderBy(F.desc(keys.ts), F.asc(_SIDE), F.desc(keys.seq)).rowsBetween(Window.unboundedPreceding, 0))
    gap: Column = F.abs(seconds_between(F.col(f"_match.{keys.ts}"), keys.ts))
    if direction == "nearest":
        matched = both.withColumns({"_back": back, "_ahead": ahead}).where(F.col(_SIDE) == 1)
        nearer = F.col("_back").isNull() | (seconds_between(keys.ts, F.col(f"_ahead.{keys.ts}")) < seconds_between(F.col(f"_back.{keys.ts}"), keys.ts))
        matched = matched.withColumn("_match", F.when(nearer & F.col("_ahead").isNotNull(), F.col("_ahead")).otherwise(F.col("_back")))
    else:
        matched = both.withColumn("_match", back if direction == "backward" else ahead).where(F.col(_SIDE) == 1)
    if tolerance is not None:
        matched = matched.withColumn("_match", F.when(gap <= tolerance, F.col("_match")))
    have = {c.lower() for c in left.columns}
    added = [F.col(f"_match.{c}").alias(c + suffix if c.lower() in have else c) for c in right.columns if c != keys.symbol]
    return matched.select(f"{_LEFT}.*", *added)


def interpolated_join(left: DataFrame, right: DataFrame, values: list[str], keys: Keys = KEYS, bucket: str | None = None) -> DataFrame:
    """left with the numeric right columns `values` interpolated in time between the right rows before and after; before the first and after the last the nearest value. bucket: see asof_join."""
    narrow = right.select(keys.symbol, keys.ts, keys.seq, *values)
    both = asof_join(asof_join(left, narrow, suffix="_before", keys=keys, bucket=bucket), narrow, direction="forward", suffix="_after", keys=keys, bucket=bucket)
    before = {v: f"{v}_before" if v in left.columns else v for v in values}
    after = {v: f"{v}_after" for v in values}
    span = seconds_between(f"{keys.ts}_before", f"{keys.ts}_after")
    share = F.coalesce(F.try_divide(seconds_between(f"{keys.ts}_before", keys.ts), span), F.lit(0.0))
    filled = {f"{v}_interpolated": F.coalesce(F.col(before[v]) + share * (F.col(after[v]) - F.col(before[v])), F.col(before[v]), F.col(after[v])) for v in values}
    return both.select(*left.columns, *[c.alias(n) for n, c in filled.items()])


def asof_join_all(left: DataFrame, rights: dict[str, DataFrame], tolerance: float | None = None, keys: Keys = KEYS, width: float | None = None) -> DataFrame:
    """left with the columns of the newest row of each of several tables, none newer than the left row; names that left or an earlier table has get _name.

    All tables are united once, shuffled once by symbol and carried along in one sort, however many there are. tolerance: most seconds back, included.
    width: split each symbol into time buckets of so many seconds (see scan), so that it is not one task.
    """
    frame = lambda df: F.struct(*[F.col(c) for c in df.columns])
    # Equal times match, so a left row comes after the others of its time.
    one = lambda df, side, name: df.select(keys.symbol, keys.ts, F.struct(F.lit(side).alias("side"), F.col(keys.seq).cast("long").alias("seq")).alias("_order"), frame(df).alias(name))
    both = one(left, len(rights), _LEFT)
    for k, (name, df) in enumerate(rights.items()):
        both = both.unionByName(one(df, k, f"_of_{name}"), allowMissingColumns=True)
    places = replace(keys, seq="_order")
    carried = {f"_at_{name}": F.col(f"_of_{name}") for name in rights}
    if width:
        matched = with_running(both, {n: Running("last", c) for n, c in carried.items()}, width, places)
    else:
        matched = both.withColumns({n: F.last(c, ignorenulls=True).over(places.so_far()) for n, c in carried.items()})
    matched = matched.where(F.col(_LEFT).isNotNull())
    have, added = {c.lower() for c in left.columns}, []
    for name, df in rights.items():
        match = F.col(f"_at_{name}")
        if tolerance is not None:
            match = F.when(seconds_between(match[keys.ts], F.col(keys.ts)) <= tolerance, match)
        for c in df.columns:
            if c != keys.symbol:
                added.append(match[c].alias(f"{c}_{name}" if c.lower() in have else c))
        have |= {c.lower() for c in df.columns}
    return matched.select(f"{_LEFT}.*", *added)


def joined_on_time(base: DataFrame, sides: dict[str, DataFrame], keys: Keys = KEYS) -> DataFrame:
    """base (one row per symbol and time) with the columns of tables of the same times, null where a table has none; names that are taken get _name. All tables meet in one shuffle and one aggregate instead of a join each."""
    frame = lambda df: F.struct(*[F.col(c) for c in df.columns])
    both = base.select(keys.symbol, keys.ts, frame(base).alias("_base"))
    for name, df in sides.items():
        both = both.unionByName(df.select(keys.symbol, keys.ts, frame(df).alias(f"_of_{name}")), allowMissingColumns=True)
    each = both.groupBy(keys.symbol, keys.ts).agg(*[F.any_value(c, True).alias(c) for c in ("_base", *(f"_of_{n}" for n in sides))]).where(F.col("_base").isNotNull())
    have, added = {c.lower() for c in base.columns}, []
    for name, df in sides.items():
        added += [F.col(f"_of_{name}")[c].alias(f"{c}_{name}" if c.lower() in have else c) for c in df.columns if c not in (keys.symbol, keys.ts)]
        have |= {c.lower() for c in df.columns}
    return each.select("_base.*", *added)
