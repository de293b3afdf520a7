"""Mixing sources to target weights by hash thresholds, in DataFrame functions only.

Each document has a hash. Sizes are summed by source and hash bucket; running sums over the buckets show in which bucket
a source's budget ends. Only that boundary bucket is refined, by further bits of the hash and then by whole hashes. The
budgets of a source are nested: a document is taken once for each full pass over its source that the target holds, and
once more if its hash is at most the threshold. Nothing sorts the documents; they are filtered by their hash.

Rows: one output row per input row. Null text has size 0; null sources form one source. Very long texts count whole. Rows that are equal in all of
id, source and text share a hash and are taken alike. Empty tables give empty results; without any words all targets
are 0. Input columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, checkpointed, extend, sized

WEIGHTS = (1, 2, 3)
MOST = 3  # times a source's size
#: Bits of the hash for the first histogram and for the refinement; hashes have 63 bits.
BITS, HASH_BITS = 12, 63
#: A thresholds table of at most so many rows, as counted, is broadcast.
FEW = 20_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: Column, source: Column, text: Column) -> Column:
    """63-bit hash, never negative."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("mix"), doc_id, source, text), 1)


def targets(totals: DataFrame) -> DataFrame:
    """totals (source, source_size) with the target of each source: shares of the whole by weight, none above MOST times its source, the excess reshared by weight. The windows run over the table of sources."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS)).cast("double")
    capped = totals.select("source", "source_size", weight.alias("weight"), (MOST * F.col("source_size")).cast("double").alias("cap"))
    # In the order in which sources reach their caps, level i shares what earlier caps leave among the weights from i on.
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    later = F.sum("weight").over(by_cap.rowsBetween(0, W.unboundedFollowing))
    everything = W.partitionBy(F.lit(0))
    levels = capped.withColumn("level", (F.sum("source_size").over(everything) - earlier) / later)
    fits = F.col("level") <= F.col("cap") / F.col("weight")
    return levels.withColumn("level", F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]).select(
        "source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target")
    )


def _boundary(sums: DataFrame, keys: list[str]) -> DataFrame:
    """sums (source, budget, before, *keys, n): for each source the row in which the running sum passes the budget."""
    run = W.partitionBy("source").orderBy(*keys)
    return sums.withColumn("after", F.col("before") + F.sum("n").over(run)).withColumn("before", F.col("after") - F.col("n")).where((F.col("before") <= F.col("budget")) & (F.col("after") > F.col("budget")))


def thresholds(compact: DataFrame) -> DataFrame:
    """compact (source, hash, size), a checkpointed table: for each source its source_size, target, passes (full ones) and cut, the largest hash taken once more."""
    totals = targets(compact.groupBy("source").agg(F.sum("size").alias("source_size")))
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST))).otherwise(0).cast("long")
    plan = checkpointed(totals.withColumn("passes", passes).withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size")))
    small = sized(plan, FEW)
    same = lambda a, b, *keys: [F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")), *[F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in keys]]
    first, second = F.shiftright("hash", HASH_BITS - BITS), F.shiftright("hash", HASH_BITS - 2 * BITS)
    coarse = compact.groupBy("source", first.alias("first")).agg(F.sum("size").alias("n")).alias("h").join(small.alias("p"), same("h", "p")).select("h.*", "budget", F.lit(0).cast("long").alias("before"))
    edge = sized(checkpointed(_boundary(coarse, ["first"]).select("source", "first", "budget", "before")), FEW)
    inner = compact.withColumn("first", first).alias("d").join(edge.alias("e"), same("d", "e", "first")).select("d.*", "budget", "before")
    fine = inner.groupBy("source", "budget", "before", second.alias("second")).agg(F.sum("size").alias("n"))
    edge = sized(checkpointed(_boundary(fine, ["second"]).select("source", "second", "budget", "before")), FEW)
    inner = compact.withColumn("second", second).alias("d").join(edge.alias("e"), same("d", "e", "second")).select("d.*", "budget", "before")
    last = _boundary(inner.groupBy("source", "budget", "before", "hash").agg(F.sum("size").alias("n")), ["hash"])
    nearer = (F.col("after") - F.col("budget")) < (F.col("budget") - F.col("before"))
    cuts = last.select("source", (F.col("hash") - F.when(nearer, 0).otherwise(1)).alias("cut"))
    joined = plan.alias("p").join(cuts.alias("c"), same("p", "c"), "left")
    return joined.select("p.source", "source_size", "target", "passes", F.coalesce("cut", F.lit(-1)).alias("cut"))


def mix(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with size, source_size, target, copies (how often the mix takes the document) and taken = copies * size."""
    compact = checkpointed(docs.select("source", size_of(F.col(text)).alias("size"), hash_of(F.col("doc_id"), F.col("source"), F.col(text)).alias("hash")))
    measured = extend(docs, size=size_of(F.col(text)), _hash=hash_of(F.col("doc_id"), F.col("source"), F.col(text)))
    return taken(measured, compact)


def mix_compact(docs: DataFrame, text: str = "text") -> DataFrame:
    """mix without the text, which is read once only."""
    compact = checkpointed(extend(docs, size=size_of(F.col(text)), _hash=hash_of(F.col("doc_id"), F.col("source"), F.col(text))).drop(text))
    return taken(compact, compact.select("source", "size", F.col("_hash").alias("hash")))


def taken(measured: DataFrame, compact: DataFrame) -> DataFrame:
    names = ("source_size", "target", "passes", "cut")
    measured = measured.drop(*[c for c in measured.columns if c.lower() in (*names, "copies", "taken")])
    plan = sized(checkpointed(thresholds(compact)), FEW)
    joined = measured.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")), "left").select("d.*", *[F.col(f"p.{x}") for x in names])
    copies = F.col("passes") + (F.col("_hash") <= F.col("cut")).cast("long")
    return extend(extend(joined, copies=copies), taken=F.col("copies") * F.col("size")).drop("_hash", "passes", "cut")
