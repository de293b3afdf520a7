"""Language-model scores from a log-frequency Bloom filter.

Counts of all tokens and of all pairs of tokens that follow each other are quantised to powers of two; an n-gram of level
q puts the keys (n-gram, 1) to (n-gram, q) into a Bloom filter. A scorer probes level after level until one is absent, so
the filter alone yields smoothed probabilities. It has room for the most keys that its training tokens can make, and no
level or n-gram is left out. All keys of an n-gram lie in one segment of the filter. A filter of at most `max_bits` is built
in segments by Spark and broadcast. A larger one is the same filter, bit for bit, with its segments dealt to buckets: each
unit of texts sends its distinct n-grams to the buckets of their segments, where these are built from the counts and probed,
and gets the levels back. Scores don't depend on which of the two it is. Base scores use exact counts: those of the `hot` most frequent tokens (a
bounded table) where the texts are read, all others by a join, whose common words Spark splits as skewed keys.

Tokens are the lower-cased (A-Z) words of a text, then one end token, the empty string. Null text is empty text: the end
token alone. Rows: one output row per input row; repeated rows get equal results. Ties among tokens as frequent as the
last hot one are broken by the token; they change no result. An empty table gives an empty result; without training
documents all counts are 0. Very long texts and words are taken whole. Only the id and text columns of the input are
read, so other columns can't clash. The order is two: single tokens and pairs.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, bucket_of, remove, shuffles_dropped, texts_of, written
from .textstats import numbered

ADD = 0.1  # to every count of the base score
AT_ONCE = 65_536  # n-grams whose places in the filter are held at a time


@dataclass(frozen=True)
class Settings:
    """hot: most tokens whose exact counts go to the workers, each of at most hot_bytes; weight: of the pair estimate against the single word's; bits_per_key and probes of the filter (keys: two to a training token); segment_bits: of the parts it is built in; max_bits: of a filter that is broadcast; unit, unit_bytes: texts taken together and about how many bytes they have; units_at_once: sent to Python in a batch; bucket_tokens: training tokens to a bucket of segments."""

    folds: int = 10
    held_out: int = 0
    hot: int = 131_072
    hot_bytes: int = 64
    weight: float = 0.7
    bits_per_key: int = 10
    probes: int = 5
    segment_bits: int = 18
    max_bits: int = 1 << 28
    unit: int = 1024
    unit_bytes: int = 2_000_000
    units_at_once: int = 4
    bucket_tokens: int = 1_000_000


def tokens(data: bytes | None) -> list[bytes]:
    words = (data or b"").lower().split()
    words.append(b"")
    return words


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keyed(grams: np.ndarray, level: int | np.ndarray) -> np.ndarray:
    """Filter keys of n-gram hashes at a level."""
    return mixed(grams + np.asarray(level, np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * np.uint64(0x9E3779B97F4A7C15) + second)


def positions(keys: np.ndarray, s: Settings) -> np.ndarray:
    """Bits of each key within its segment: (keys, probes)."""
    step = mixed(keys) | np.uint64(1)
    at = (keys >> np.uint64(40))[:, None] + np.arange(s.probes, dtype=np.uint64) * step[:, None]
    return (at & np.uint64((1 << s.segment_bits) - 1)).astype(np.int64)


def placed(grams: np.ndarray) -> np.ndarray:
    """N-gram hashes as the filter takes them: a permutation, whose low bits name the segment."""
    return mixed(grams * np.uint64(0x9E3779B97F4A7C15))


@dataclass
class LogFrequencyFilter:
    """bits: bytes of the segments, one row each: of all, or of those whose number is a bucket's in its `shift` low bits."""

    settings: Settings
    bits: np.ndarray
    shift: int = 0

    def segments(self, at: np.ndarray) -> np.ndarray:
        return ((at >> np.uint64(self.shift)) & np.uint64(len(self.bits) - 1)).astype(np.int64)

    def holds(self, at: np.ndarray, level: int) -> np.ndarray:
        bit = positions(keyed(at, level), self.settings)
        return ((self.bits[self.segments(at)[:, None], bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).all(1)

    def found(self, at: np.ndarray) -> np.ndarray:
        """The level of each placed n-gram by repeated probes, 0 if it is absent."""
        out = np.zeros(len(at), np.uint8)
        for start in range(0, len(at), AT_ONCE):
            part, own = at[start : start + AT_ONCE], out[start : start + AT_ONCE]
            left, level = np.arange(len(part)), 1
            while len(left) and level < 64:
                left = left[self.holds(part[left], level)]
                own[left] = level
                level += 1
        return out

    def levels(self, grams: np.ndarray) -> np.ndarray:
        return self.found(placed(grams))

    def counts(self, grams: np.ndarray) -> np.ndarray:
        return estimated(self.levels(grams))


def estimated(level: np.ndarray) -> np.ndarray:
    """Counts: the middle of the level's range."""
    return np.where(level > 1, 1.5 * 2.0 ** (level.astype(np.int64) - 1), level)


class Unit:
    """Texts taken together: their distinct tokens and pairs; before a text stands the end token."""

    def __init__(self, texts: list[bytes | None]):
        each = [tokens(data) for data in texts]
        self.lengths = np.array([len(words) for words in each], np.int64)
        ends = np.cumsum(self.lengths)
        self.starts = ends - self.lengths
        self.distinct, self.ids = numbered([w for words in each for w in words])
        self.words = np.array([xxhash.xxh3_64_intdigest(w) for w in self.distinct], np.uint64)
        self.before = np.roll(self.ids, 1)
        self.before[self.starts] = self.ids[ends - 1]  # the end token is the last
        codes, self.pair = np.unique((self.before << 32) | self.ids, return_inverse=True)
        self.pairs = paired(self.words[codes >> 32], self.words[codes & 0xFFFFFFFF])

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per text, of values per token place."""
        return np.add.reduceat(values, self.starts)

    def in_buckets(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All n-grams placed, their buckets by the low bits, and their order by bucket."""
        grams = placed(np.concatenate([self.words, self.pairs]))
        of = (grams & np.uint64(buckets - 1)).astype(np.int64)
        return grams, of, np.argsort(of, kind="stable")

    def scores(self, single: np.ndarray, both: np.ndarray, total: int, distinct: int, s: Settings) -> np.ndarray:
        """log10 probability of each text from the estimated counts of the distinct tokens and of the pairs; total and distinct as in the base score."""
        p = ((single + ADD) / (total + ADD * (distinct + 1)))[self.ids]
        known = np.flatnonzero(single[self.before] > 0)
        p[known] = (1 - s.weight) * p[known] + s.weight * np.minimum(1, both[self.pair[known]] / single[self.before[known]])
        return self.sums(np.log10(p))


def units(texts: pa.Array, s: Settings) -> Iterator[tuple[int, int]]:
    """Start and length of each unit of an array of texts."""
    ends = np.cumsum([len(x or b"") for x in texts_of(texts)])
    at = 0
    while at < len(ends):
        room = (ends[at - 1] if at else 0) + s.unit_bytes
        n = min(s.unit, max(1, int(np.searchsorted(ends, room, "right")) - at))
        yield at, min(n, len(ends) - at)
        at += n


def token_counts(training: DataFrame) -> DataFrame:
    """(token, n): all tokens of the texts. Each task adds up its own before the shuffle."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

        for batch in batches:
            for data in texts_of(batch.column(0)):
                seen.update(tokens(data))
                if len(seen) > 300_000:
                    yield out()
                    seen.clear()
        yield out()

    return training.mapInArrow(scan, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def pair_counts(training: DataFrame, s: Settings) -> DataFrame:
    """(gram, n): hashes of all pairs of tokens that follow each other."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in units(batch.column(0), s):
                u = Unit(texts_of(batch.column(0).slice(at, n)))
                yield pa.record_batch([pa.array(u.pairs.view(np.int64)), pa.array(np.bincount(u.pair))], ["gram", "n"])

    return training.mapInArrow(scan, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def level_of(n: str) -> F.Column:
    """1 + floor(log2 n) for n of at least 1."""
    return F.length(F.bin(F.col(n))).cast("int")


def bits_for(keys: int, s: Settings) -> int:
    """Bits of a filter of so many keys: a power of two, one segment at least."""
    return 1 << max(s.segment_bits, (max(1, keys) * s.bits_per_key - 1).bit_length())


def all_keys(at: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Placed n-grams, each as often as it has levels, and their keys at all levels up to their own."""
    rank = np.arange(level.sum()) - np.repeat(np.cumsum(level) - level, level) + 1
    at = np.repeat(at, level)
    return at, keyed(at, rank)


def local_filter(at: np.ndarray, level: np.ndarray, segments: int, buckets: int, s: Settings) -> LogFrequencyFilter:
    """The segments of one bucket, from its placed n-grams."""
    part = LogFrequencyFilter(s, np.zeros((segments // buckets, 1 << (s.segment_bits - 3)), np.uint8), buckets.bit_length() - 1)
    flat = np.zeros((len(part.bits), 1 << s.segment_bits), bool)
    for start in range(0, len(at), AT_ONCE):
        own, keys = all_keys(at[start : start + AT_ONCE], level[start : start + AT_ONCE])
        flat[part.segments(own)[:, None], positions(keys, s)] = True
    part.bits = np.packbits(flat, axis=1, bitorder="little")
    return part


def build_filter(singles: DataFrame, pairs: DataFrame, s: Settings, most: int | None = None) -> LogFrequencyFilter:
    """singles (token, n), pairs (gram, n), and the most keys there can be (default: they are counted). The driver gets the segments, max_bits in all; a filter that would need more has all keys too, but answers wrongly more often."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = np.array([xxhash.xxh3_64_intdigest(w) for w in b.column(0).to_pylist()], np.uint64)
            yield pa.record_batch([pa.array(grams.view(np.int64)), b.column(1)], ["gram", "level"])

    graded = singles.select("token", level_of("n").alias("level")).mapInArrow(hashed, "gram long, level int").union(pairs.select("gram", level_of("n")))
    if most is None:
        levels = singles.select(level_of("n").alias("level")).union(pairs.select(level_of("n")))
        most = levels.agg(F.coalesce(F.sum("level"), F.lit(0))).first()[0]
    segments = min(bits_for(most, s), s.max_bits) >> s.segment_bits

    def part(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        flat = np.zeros(1 << s.segment_bits, bool)
        flat[positions(g["key"].to_numpy().view(np.uint64), s).ravel()] = True
        return pd.DataFrame({"segment": [key[0]], "bits": [np.packbits(flat, bitorder="little").tobytes()]})

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams, level = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy().astype(np.int64)
            if not len(grams):
                continue
            at, out = all_keys(placed(grams), level)
            yield pa.record_batch([pa.array(out.view(np.int64)), pa.array((at & np.uint64(segments - 1)).astype(np.int32))], ["key", "segment"])

    table = np.zeros((segments, 1 << (s.segment_bits - 3)), np.uint8)
    for r in graded.mapInArrow(keys, "key long, segment int").groupBy("segment").applyInPandas(part, "segment int, bits binary").toLocalIterator():
        table[r.segment] = np.frombuffer(r.bits, np.uint8)
    return LogFrequencyFilter(s, table)


def packed(docs: DataFrame, s: Settings, paths: list[str]) -> DataFrame:
    """(unit, docs): the rows of docs, the column text among them, in units of one row each, written."""
    kind = docs.schema.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n in units(b.column("text"), s):
                yield pa.record_batch([pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), b.slice(at, n).to_struct_array())], ["docs"])

    with arrow_batches(docs.sparkSession, s.unit):
        return written(docs.mapInArrow(scan, f"docs array<{kind}>").select(F.monotonically_increasing_id().alias("unit"), "docs"), paths)


def bucket_levels(packs: DataFrame, segments: int, buckets: int, s: Settings, paths: list[str]) -> DataFrame:
    """(unit, found): the levels of a unit's n-grams, an array of (bucket, levels) by bucket. One row of n-grams (without the bits that the bucket's number tells) and their training counts goes from each unit to each bucket of them, and one of levels back; there are no more rows than n-grams."""
    shift = buckets.bit_length() - 1
    width = (64 - shift + 7) // 8

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for unit, docs in zip(b.column("unit").to_pylist(), b.column("docs")):
                u = Unit(texts_of(docs.values.field("text")))
                learned = np.repeat(~np.array(docs.values.field("held_out").to_pylist(), bool), u.lengths)
                n = np.concatenate([np.bincount(of[learned], minlength=k) for of, k in ((u.ids, len(u.words)), (u.pair, len(u.pairs)))])
                grams, of, order = u.in_buckets(buckets)
                found, cuts = np.unique(of[order], return_index=True)
                high = np.split((grams[order] >> np.uint64(shift)).view(np.uint8).reshape(-1, 8)[:, :width], cuts[1:])
                counts = [x.astype(np.min_scalar_type(x.max())) for x in np.split(n[order], cuts[1:])]
                parts = [pa.array([x.tobytes() for x in y], pa.binary()) for y in (high, counts)]
                yield pa.record_batch([pa.array(np.full(len(found), unit)), pa.array(found), *parts], ["unit", "bucket", "grams", "n"])

    def probed(g: pd.DataFrame) -> pd.DataFrame:
        sizes = [len(x) // width for x in g["grams"]]
        hashes = np.zeros((sum(sizes), 8), np.uint8)
        hashes[:, :width] = np.frombuffer(b"".join(g["grams"]), np.uint8).reshape(-1, width)
        grams, at = np.unique(hashes.view(np.uint64).ravel() << np.uint64(shift) | np.uint64(g["bucket"].iloc[0]), return_inverse=True)
        del hashes
        n = np.bincount(at, np.concatenate([np.frombuffer(x, f"u{len(x) // k}") for x, k in zip(g["n"], sizes)]))
        learned = n > 0
        model = local_filter(grams[learned], np.frexp(n[learned])[1].astype(np.int64), segments, buckets, s)
        level = np.split(model.found(grams)[at], np.cumsum(sizes)[:-1])
        return pd.DataFrame({"unit": g["unit"], "bucket": g["bucket"], "levels": [x.tobytes() for x in level]})

    probes = packs.mapInArrow(asked, "unit long, bucket long, grams binary, n binary")
    with arrow_batches(packs.sparkSession, s.units_at_once):
        levels = written(probes.groupBy("bucket").applyInPandas(probed, "unit long, bucket long, levels binary"), paths)
    return levels.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("bucket", "levels"))).alias("found"))


def score(docs: DataFrame, s: Settings = Settings(), text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all docs (doc_id, text)."""
    spark = docs.sparkSession
    held = bucket_of(F.col("doc_id"), s.folds) == s.held_out
    training = docs.where(~held).select(F.col(text).cast("binary").alias("text"))
    with shuffles_dropped(spark):
        singles = written(token_counts(training))
    total, distinct = singles.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = singles.where(F.length("token") <= s.hot_bytes).orderBy(F.desc("n"), "token").limit(s.hot).collect()
    exact = spark.sparkContext.broadcast({bytes(r.token): r.n for r in top})
    numbered_docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held.alias("held_out"), F.col(text).cast("binary").alias("text"))

    def rows(part: pa.StructArray, u: Unit, single: np.ndarray, both: np.ndarray) -> pa.RecordBatch:
        n = np.fromiter((exact.value.get(w, 0) for w in u.distinct), np.int64, len(u.distinct))
        hot = n > 0
        cold = np.flatnonzero(~hot[u.ids])
        codes, often = np.unique((np.repeat(np.arange(len(u.lengths)), u.lengths)[cold] << 32) | u.ids[cold], return_counts=True)
        ends = pa.array(np.searchsorted(codes >> 32, np.arange(len(u.lengths) + 1)), pa.int32())
        words = pa.array([u.distinct[k] for k in (codes & 0xFFFFFFFF).tolist()], pa.binary())
        made = [u.lengths, u.scores(single, both, total, distinct, s), u.sums(np.where(hot, np.log10(n + ADD), 0.0)[u.ids]), u.sums(hot[u.ids].astype(np.int64))]
        lists = [pa.ListArray.from_arrays(ends, x) for x in (words, pa.array(often.astype(np.int64)))]
        return pa.record_batch([*(part.field(x) for x in ("row", "doc_id", "held_out")), *map(pa.array, made), *lists], ["row", "doc_id", "held_out", "n_tokens", "score", "hot_score", "hot_known", "cold", "cold_n"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n in units(b.column("text"), s):
                part = b.slice(at, n).to_struct_array()
                u = Unit(texts_of(part.field("text")))
                yield rows(part, u, model.value.counts(u.words), model.value.counts(u.pairs))

    def scan_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, found in zip(b.column("docs"), b.column("found")):
                u = Unit(texts_of(part.values.field("text")))
                counts = np.zeros(len(u.words) + len(u.pairs))
                counts[u.in_buckets(buckets)[2]] = estimated(np.frombuffer(b"".join(found.values.field("levels").to_pylist()), np.uint8))
                yield rows(part.values, u, counts[: len(u.words)], counts[len(u.words) :])

    kinds = f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, score double, hot_score double, hot_known long, cold array<binary>, cold_n array<long>"
    most = 2 * total  # a token makes at most one key of its own and one of its pair
    segments = bits_for(most, s) >> s.segment_bits
    if segments << s.segment_bits <= s.max_bits:
        model = spark.sparkContext.broadcast(build_filter(singles, written(pair_counts(training, s)), s, most))
        scored = written(numbered_docs.mapInArrow(scan, kinds))
    else:
        buckets = min(segments, 1 << (total // s.bucket_tokens).bit_length())
        paths: list[str] = []
        with shuffles_dropped(spark):  # each table is written once, and the next needs no shuffle of the one before
            packs = packed(numbered_docs, s, paths)
            found = bucket_levels(packs, segments, buckets, s, paths)
            with arrow_batches(spark, s.units_at_once):
                scored = written(packs.join(found, "unit").select("docs", "found").mapInArrow(scan_units, kinds))
        remove(spark, paths)
    cold = scored.select("row", F.explode(F.arrays_zip(F.col("cold").alias("token"), F.col("cold_n").alias("often"))).alias("c")).select("row", "c.token", "c.often")
    counted = cold.join(singles, "token", "left").select("row", "often", F.coalesce("n", F.lit(0)).alias("n"))
    sums = counted.groupBy("row").agg(F.sum(F.col("often") * F.log10(F.col("n") + ADD)).alias("cold_score"), F.sum(F.when(F.col("n") > 0, F.col("often")).otherwise(0)).alias("cold_known"))
    joined = scored.drop("cold", "cold_n").join(sums, "row", "left")
    base = F.col("hot_score") + F.coalesce("cold_score", F.lit(0.0)) - F.col("n_tokens") * math.log10(total + ADD * (distinct + 1))
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("hot_known") + F.coalesce("cold_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
