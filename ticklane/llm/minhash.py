"""MinHash near-duplicates with tensored banding.

Two collections of band hashes are computed, each band from a few minhashes; every pair of a band of the first and one of
the second is a table key, so `bands` squared tables need only two times `bands` bands. Documents of equal shingle sets
form a class with one representative. A pair of representatives meets in a table only if it shares a band of either
collection, so bands that no two representatives share are dropped before keys are made: most documents make no key.

Representatives that share a table key are candidates. For a few rounds each is compared with one document that stands for
the least component of its keys, the one it shares most keys with; a component so found counts as one from then on. What
is left are pairs of different components. These meet in the groups of a first-collection band: a group's most common
component is dealt against the others only, in blocks; signatures find the pairs that share a table key, and whole sets
of their documents are compared as products of 0/1 matrices. Links are confirmed on full shingle sets in every step.

A document's set holds its distinct shingles of `width` words, lower-cased (A-Z); with fewer words it is the whole
sequence as one shingle. Two documents are linked if 100 * intersection >= percent * union. A pair of similarity 0.8
meets in some table with a probability of 0.997, one of 0.9 of 0.99999; near copies mostly have several partners.

Rows: one output row per input row. Documents without words, and rows without an id, are linked with nothing and kept.
Rows that repeat an id and text have one class and equal results; different texts under one id count as one document when
components are named. Ties need no breaking: the smallest id names a
component. Very long texts are hashed whole, in pieces. Empty tables give empty results. Only the id and text columns of
the input are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, checkpointed, remove, sized, texts_of, written
from .components import connected_components
from .textstats import numbered


#: Tables of ids of at most so many rows, as counted, are broadcast.
FEW = 500_000


@dataclass(frozen=True)
class Settings:
    """width: words of a shingle; percent: least similarity; bands: in each collection; rows: minhashes of a band; agree: least share of equal signature parts of a pair whose sets are compared in blocks (a pair at the threshold has 80 % on average, 3.7 deviations more); rounds: comparisons of each document with one other before blocks; block, block_shingles: documents compared at once on either side, and about how many shingles they have."""

    width: int = 5
    percent: int = 80
    bands: int = 9
    rows: int = 3
    agree: float = 0.6
    rounds: int = 2
    block: int = 256
    block_shingles: int = 500_000

    @property
    def hashes(self) -> int:
        return 2 * self.bands * self.rows


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers mixed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(data: bytes, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = data.lower().split()  # bytes: A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    distinct, ids = numbered(words)
    hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct], np.uint64)[ids]
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashed[k : len(words) - width + 1 + k])
    return np.unique(out)


def minhashes(found: np.ndarray, factors: np.ndarray) -> np.ndarray:
    best = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 2048):
        np.minimum(best, (found[at : at + 2048, None] * factors).min(0), out=best)
    return mixed(best)


def signature(docs: DataFrame, s: Settings, text: str) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_hash, u, v, parts): a hash of the text and the digest of its set, the bands of both collections, and a byte of each minhash."""

    def start():
        factors = np.random.default_rng(20_011).integers(0, 1 << 63, s.hashes, np.uint64) * np.uint64(2) + np.uint64(1)
        numbers = np.arange(2 * s.bands, dtype=np.uint64)

        def row(data: bytes) -> tuple:
            found = shingles(data, s.width)
            if not len(found):
                return 0, None, [], [], None
            low = minhashes(found, factors)
            bands = numbers
            for k in range(s.rows):
                bands = mixed(bands * np.uint64(0x9E3779B97F4A7C15) + low[k :: s.rows])
            bands = bands.view(np.int64).tolist()
            return len(found), hashlib.blake2b(found.tobytes(), digest_size=16).digest(), bands[: s.bands], bands[s.bands :], low.astype(np.uint8).tobytes()

        kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

        def batch(texts: pa.Array) -> pa.Array:
            rows = [row(t or b"") for t in texts_of(texts)]
            return pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["n_shingles", "set_hash", "u", "v", "parts"])

        return batch

    found = arrow_column(start, "struct<n_shingles:long,set_hash:binary,u:array<long>,v:array<long>,parts:binary>")
    return docs.select("doc_id", F.xxhash64(F.col(text)).alias("text_hash"), found(F.col(text)).alias("_s")).select("doc_id", "text_hash", "_s.*")


def shared_bands(classes: DataFrame) -> DataFrame:
    """(band, value, node): the bands of either collection that several nodes have; those of the second count on from the first."""
    each = classes.select("node", F.posexplode(F.concat("u", "v")).alias("band", "value"))
    several = each.groupBy("band", "value").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high")
    return each.join(several.select("band", "value"), ["band", "value"])


def table_keys(bands: DataFrame, s: Settings) -> DataFrame:
    """(node, key): the pairs of a shared band of the first and one of the second collection, a few dozen to a node at most."""
    of = bands.groupBy("node").agg(F.collect_list(F.struct("band", "value")).alias("found"))
    side = lambda first: F.explode(F.filter("found", lambda b: (b["band"] < s.bands) == F.lit(first)))
    pairs = of.select("node", "found", side(True).alias("u")).select("node", "u", side(False).alias("v"))
    return pairs.select("node", F.xxhash64("u.band", "v.band", "u.value", "v.value").alias("key"))


def with_component(nodes: DataFrame, found: DataFrame | None) -> DataFrame:
    """nodes with the component of each, by found (node, component), or itself."""
    if found is None:
        return nodes.withColumn("component", F.col("node"))
    return nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def partners(keys: DataFrame, found: DataFrame | None, tried: DataFrame | None) -> DataFrame:
    """(a, b): each node b with at most one node a that stands for the least component of a key of b's, the one of most keys; not one of the tried."""
    named = with_component(keys, found)
    least = named.groupBy("key").agg(F.min(F.struct("component", "node")).alias("low"), F.max("component").alias("high")).where("low.component != high")
    met = named.join(least.select("key", F.col("low.component").alias("of"), F.col("low.node").alias("a")), "key").where("component != of")
    counted = met.groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("n"))
    if tried is not None:
        counted = counted.join(tried, ["a", "b"], "left_anti")
    return counted.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b")


def texts_of_nodes(docs: DataFrame, nodes: DataFrame, text: str) -> DataFrame:
    """(node, text) of nodes (node, text_hash). A repeated row gives a repeated text."""
    named = docs.select(F.col("doc_id").alias("node"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    return named.join(sized(nodes.select("node", "text_hash"), FEW), ["node", "text_hash"]).select("node", F.col("text").cast("binary").alias("text"))


def in_order(rows: DataFrame, by: list[str], then: list[str | Column]) -> DataFrame:
    """rows dealt by the columns by, groups in one piece and sorted. Few bytes but much work a row: a fixed number of tasks, or small partitions would be joined into a few."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by, *then)


def is_similar(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """one and other: sorted distinct shingles."""
    few, many = sorted((one, other), key=len)
    if 100 * len(few) < percent * len(many):
        return False
    common = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())
    return 100 * common >= percent * (len(one) + len(other) - common)


def confirmed(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b), a checkpointed table, whose full sets are similar enough. Each text of b goes to a's; a document with very many pairs is dealt in chunks of about `block` of them."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / s.block).alias("chunks"))
    dealt = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"), "b")
    others = dealt.join(texts.withColumnRenamed("node", "b"), "b").select("a", "chunk", "b", "text")
    ones = dealt.select("a", "chunk").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "chunk", F.lit(None).cast("long").alias("b"), "text")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, ones = None, []
        for batch in batches:
            found = []
            a_, chunk_, b_ = (batch.column(c).to_pylist() for c in ("a", "chunk", "b"))
            for a, chunk, b, data in zip(a_, chunk_, b_, batch.column("text")):
                if of != (a, chunk):
                    of, ones = (a, chunk), []
                full = shingles(data.as_py(), s.width)
                if b is None:
                    ones.append(full)
                elif any(is_similar(one, full, s.percent) for one in ones):
                    found.append((a, b))
            yield pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return in_order(others.union(ones), ["a", "chunk"], [F.asc_nulls_first("b")]).mapInArrow(compared, "a long, b long").distinct()


def in_blocks(bands: DataFrame, of: DataFrame, s: Settings) -> DataFrame:
    """The documents of the first collection's bands that join different components, dealt in blocks.

    bands: (band, value, node); of: (node, component, n_shingles, ...). A band's documents are those of its most common component, the main ones, and the others. Blocks x of others meet each other once and all blocks y of main ones; main ones don't meet. A row for each document and block that its own one meets; a group (band, value, x, y) has about two blocks' rows and shingles at most.
    """
    members = bands.where(F.col("band") < s.bands).join(of.select("node", "component", "n_shingles"), "node")
    parts = members.groupBy("band", "value", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    groups = parts.groupBy("band", "value").agg(F.max(F.struct("n", "size", "component")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size")).where("main.n < n")
    blocks = lambda n, size: F.greatest(F.ceil(n / s.block), F.ceil(size / s.block_shingles)).cast("int")
    main, others = blocks(F.col("main.n"), F.col("main.size")), blocks(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size"))
    dealt = members.select("band", "value", "node", "component").join(groups.select("band", "value", F.col("main.component").alias("of"), main.alias("main"), others.alias("others")), ["band", "value"])
    is_main = F.col("component") == F.col("of")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    own = F.when(is_main, F.col("others") + place("main")).otherwise(place("others"))
    last = F.col("others") - 1 + F.when(is_main, 0).otherwise(F.col("main"))
    met = dealt.select("band", "value", "node", own.alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    return met.select("band", "value", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node")


GROUP = ["band", "value", "x", "y"]


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each group, which lie in one piece."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pa.concat_batches([rest, batch])
        if not batch.num_rows:
            continue
        ids = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in GROUP])
        cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
        rest = batch.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The number of equal bytes of each row of x and each of y."""
    return sum((x[:, k][:, None] == y[:, k][None]).astype(np.uint8) for k in range(x.shape[1]))


def candidates(g: pa.RecordBatch, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of block x and of block y in a group, and which pairs of them are candidates: of different components and similar sizes, with agreeing signatures, that share a table key and no earlier band of the first collection."""
    own, comp, n = (g.column(c).to_numpy() for c in ("own", "component", "n_shingles"))
    parts = np.frombuffer(b"".join(g.column("parts").to_pylist()), np.uint8).reshape(len(own), -1)
    u, v = (np.array(g.column(c).to_pylist(), np.int64).reshape(len(own), -1) for c in ("u", "v"))
    at, x, y = g.column("band")[0].as_py(), g.column("x")[0].as_py(), g.column("y")[0].as_py()
    i, j = np.flatnonzero(own == x), np.flatnonzero(own == y)
    a, b = n[i][:, None], n[j][None]
    pair = (comp[i][:, None] != comp[j][None]) & (100 * np.minimum(a, b) >= s.percent * np.maximum(a, b))
    if x == y:
        pair = np.triu(pair, 1)
    if pair.any():
        pair &= agreement(parts[i], parts[j]) >= int(np.ceil(s.agree * s.hashes))
        pair &= sum((v[i, k][:, None] == v[j, k][None]) for k in range(s.bands)) > 0
        for k in range(at):
            pair &= u[i, k][:, None] != u[j, k][None]
    return i, j, pair


def common_sizes(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, columns: int = 4096) -> np.ndarray:
    """The sizes of the intersections of each set of i with each of j, places in sets: products of 0/1 matrices over the shingles that several have."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
    several = np.cumsum(n > 1) - 1
    kept = n[column] > 1
    row, column = row[kept], several[column[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(i), len(j)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, (at, at + columns))
        has = np.zeros((len(sets), columns), np.float32)
        has[row[a:b], column[a:b] - at] = 1
        out += has[i] @ has[j].T
    return out.astype(np.int64)


def links_left(blocks: DataFrame, facts: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) that connect whatever the candidates of blocks link. facts: (node, component, n_shingles, parts, u, v). A block gives no more links than it has documents."""
    kinds = "band int, value long, x int, y int, own int, node long"

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in whole_groups(batches):
            i, j, pair = candidates(g, s)
            rows = np.union1d(i[pair.any(1)], j[pair.any(0)])
            if len(rows):
                yield g.take(pa.array(rows)).select([*GROUP, "own", "node"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in whole_groups(batches):
            own, node, comp = (g.column(c).to_numpy() for c in ("own", "node", "component"))
            sets = [shingles(t, s.width) for t in g.column("text").to_pylist()]
            n = np.array([len(x) for x in sets])
            i, j = np.flatnonzero(own == g.column("x")[0].as_py()), np.flatnonzero(own == g.column("y")[0].as_py())
            common = common_sizes(sets, i, j)
            a, b = np.nonzero((comp[i][:, None] != comp[j][None]) & (100 * common >= s.percent * (n[i][:, None] + n[j][None] - common)))
            root = {c: c for c in comp.tolist()}
            links = []
            for one, other in zip(i[a].tolist(), j[b].tolist()):
                ends = []
                for c in (int(comp[one]), int(comp[other])):
                    while root[c] != c:
                        root[c] = c = root[root[c]]
                    ends.append(c)
                if ends[0] != ends[1]:
                    root[ends[0]] = ends[1]
                    links.append((int(node[one]), int(node[other])))
            yield pa.record_batch([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    wanted = in_order(blocks.join(facts, "node").select(*GROUP, "own", "node", "component", "n_shingles", "parts", "u", "v"), GROUP, []).mapInArrow(asked, kinds)
    met = wanted.join(facts.select("node", "component"), "node").join(texts, "node")
    return in_order(met.select(*GROUP, "own", "node", "component", "text"), GROUP, []).mapInArrow(linked, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, s: Settings = Settings(), text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of all docs (doc_id, text)."""
    done: list[str] = []
    every = written(signature(docs, s, text))
    able = every.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    least = F.min(F.struct("doc_id", "text_hash", "n_shingles", "u", "v", "parts")).alias("c")
    classes = written(able.groupBy("set_hash").agg(least, F.count("*").alias("copies")).select("set_hash", "copies", F.col("c.doc_id").alias("node"), "c.text_hash", "c.n_shingles", "c.u", "c.v", "c.parts"))
    bands = written(shared_bands(classes), done)
    keys = written(table_keys(bands, s), done)
    facts = written(classes.drop("set_hash", "copies").join(sized(keys.select("node").distinct(), FEW), "node", "left_semi"), done)
    texts = written(texts_of_nodes(docs, facts, text), done)
    links = tried = found = None
    for _ in range(s.rounds):
        pairs = checkpointed(partners(keys, found, tried))
        tried = pairs if tried is None else tried.union(pairs)
        more = checkpointed(confirmed(pairs, texts, s))
        links = more if links is None else links.union(more)
        found = connected_components(links)
    of = written(with_component(facts, found), done)
    links = links.union(checkpointed(links_left(in_blocks(bands, of, s), of, texts, s)))
    found = connected_components(links)
    remove(docs.sparkSession, done)
    # Most documents are alone; the others' sets name their components. A null set gets a key of its own, or all would meet.
    named = with_component(classes.select("set_hash", "node", "copies"), found).where("copies > 1 or component != node").select(F.col("set_hash").alias("key"), "component")
    key = F.coalesce("set_hash", F.concat(F.lit("without words or id: "), F.coalesce("doc_id", "text_hash").cast("string")).cast("binary"))
    out = every.select("doc_id", "n_shingles", key.alias("key")).join(named, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
