"""Running aggregates of a series over many tasks: a scan in two levels.

A series is cut into time buckets. Each bucket is aggregated (in part before the shuffle), the totals are carried along the small
table of buckets, and each bucket starts its own running aggregate from what is carried to it, as a row before its first. Rows are
shuffled once, by (symbol, bucket), and no task sorts a whole symbol. Any aggregate that combines associatively fits; results don't depend on
the width of the buckets (sums and products of floating-point numbers but for rounding).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import col
from .keys import KEYS, Keys

DAY = 86_400.0
KINDS = {
    "sum": F.sum,
    "product": F.product,
    "max": F.max,
    "min": F.min,
    "last": lambda c: F.last(c, ignorenulls=True),
}


@dataclass(frozen=True)
class Running:
    """A running aggregate of a value, nulls ignored: sum, product, max, min, last or count (of rows). earlier: over the rows before the current one only."""

    kind: str
    value: Column | str | None = None
    earlier: bool = False

    def column(self) -> Column:
        return F.lit(1).cast("long") if self.kind == "count" else col(self.value)

    def over(self, c: Column) -> Column:
        return KINDS["sum" if self.kind == "count" else self.kind](c)

    def total(self, c: Column, place: Column) -> Column:
        """The aggregate of a bucket; place orders its rows."""
        return F.max_by(c, F.when(c.isNotNull(), place)) if self.kind == "last" else self.over(c)


def time_bucket(keys: Keys, width: float) -> Column:
    """The number of the bucket of `width` seconds that a row's time falls in."""
    return F.floor(F.unix_micros(F.col(keys.ts).cast("timestamp")) / F.lit(max(1, int(width * 1e6))))


def with_running(df: DataFrame, columns: dict[str, Running], width: float = DAY, keys: Keys = KEYS, reverse: bool = False) -> DataFrame:
    """df with the running aggregates, null where nothing was aggregated; reverse runs from a series' end. Rows of equal keys run in any order."""
    names = {n: f"_s{i}" for i, n in enumerate(columns)}
    rows = df.withColumns({"_bucket": time_bucket(keys, width), **{names[n]: r.column() for n, r in columns.items()}})
    place = F.struct(keys.ts, keys.seq)
    at = {names[n]: r for n, r in columns.items()}
    if reverse:
        totals = rows.groupBy(keys.symbol, "_bucket").agg(*[(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), place)) if r.kind == "last" else r.over(F.col(c))).alias(c) for c, r in at.items()])
    else:
        totals = rows.groupBy(keys.symbol, "_bucket").agg(*[r.total(F.col(c), place).alias(c) for c, r in at.items()])
    direction = (lambda c: F.desc(c)) if reverse else (lambda c: F.asc(c))
    along = Window.partitionBy(keys.symbol).orderBy(direction("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    seeds = totals.select(keys.symbol, "_bucket", *[r.over(F.col(c)).over(along).alias(c) for c, r in at.items()], F.lit(True).alias("_seed"))
    both = rows.withColumn("_seed", F.lit(False)).unionByName(seeds, allowMissingColumns=True)
    inside = Window.partitionBy(keys.symbol, "_bucket").orderBy(F.desc("_seed"), direction(keys.ts), direction(keys.seq))
    frame = lambda r: inside.rowsBetween(Window.unboundedPreceding, -1 if r.earlier else 0)
    made = both.withColumns({n: r.over(F.col(names[n])).over(frame(r)) for n, r in columns.items()})
    return made.where("not _seed").drop("_seed", "_bucket", *names.values())


def with_totals(df: DataFrame, columns: dict[str, Column], keys: Keys = KEYS) -> DataFrame:
    """df with aggregates of each row's whole symbol, joined from the table of symbols instead of a window that holds the symbol in one task."""
    totals = df.groupBy(F.col(keys.symbol).alias("_symbol")).agg(*[c.alias(n) for n, c in columns.items()])
    kept = [c for c in df.columns if c.lower() not in {n.lower() for n in columns}]
    return df.select(*kept).join(totals, F.col(keys.symbol).eqNullSafe(F.col("_symbol")), "left").drop("_symbol")
