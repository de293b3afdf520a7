"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, component): for each node with a link to a smaller one in its component, the smallest node it can reach.

    Alternates large and small stars: each node hangs its larger, then its smaller neighbours on the least neighbour, until
    nothing changes. Minima are aggregated before shuffling; the joins that bring a node's minimum to its links hold two
    numbers a row, and a node with very many links is split there by Spark's adaptive skew join (on by default). Each
    round's table is checkpointed. Links of a node to itself, and links of a null, do nothing; no links give no rows.
    """
    edges = checkpointed(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = fingerprint(edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(rest.union(least).distinct())
        before, state = state, fingerprint(edges)
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
