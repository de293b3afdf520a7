"""Source divergence audit: how far the term shares of each (language, source) group lie from those of the language's other sources and of the language itself.

Shares are whole numbers: p = 1 + floor(SCALE * (count + 1) / (N + V)) for each of the V kept terms of the language, those in
at least `min_docs` of its documents; N sums the group's counts of them. The distance of two shares is
f(p, q) = floor((p - q)^2 / q). A pair's value sums f over all V terms, most of which stand in neither group, so it is put
together by inclusion and exclusion over the terms that do:

    V f00 + sum over g's terms (f(c, 0) - f00) + sum over h's terms (f(0, d) - f00) + sum over common terms (f(c, d) - f(c, 0) - f(0, d) + f00)

The two one-sided sums are priced once per group and distinct count (histograms of counts). The last one joins postings: of
each term the blocks of at most `block` sources that hold it, met block by block and added up in block x block matrices, so
no pair of a term becomes a row. Sums are exact: halves of 32 bits in numpy, decimals in Spark.

Hot groups: counts are summed within tasks and shuffled by language and term, never by language or source; ranks keep 200
rows per group before their shuffle. Per-group facts are broadcast only when counted small.

Rows: documents are rows, repeated ones count again. Null text, language and source are read as ''. Groups without terms and
languages without kept terms have rows of value 0 for their pairs. Ties rank by item in UTF-8 order. Very long texts are
counted whole. An empty table gives no rows; other columns of the input don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, sized, slices, texts_of

SCALE = 1_000_000_000
COUNTED = "lang string, source string, term binary, n long, docs long"
#: Bytes of a term: A-Z as a-z, a-z, and all bytes of letters beyond ASCII; the others part terms.
_TERM = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


@dataclass(frozen=True)
class Settings:
    """Least documents of a kept term, terms reported per group, sources per block of postings, term counts that a task holds, and groups whose facts may be broadcast."""

    min_docs: int = 3
    top: int = 200
    block: int = 256
    held: int = 400_000
    few: int = 100_000


def counted_terms(docs: DataFrame, settings: Settings) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term, summed within tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in groups.items():
                terms = list(n)
                given = [pa.array([x] * len(terms), pa.string()) for x in (lang, source)]
                counts = [pa.array([*map(c.__getitem__, terms)], pa.int64()) for c in (n, docs)]
                yield pa.RecordBatch.from_arrays([*given, pa.array(terms, pa.binary()), *counts], names=["lang", "source", "term", "n", "docs"])
            groups.clear()

        for batch in batches:
            for at, size in slices(batch.column(2)):
                langs, sources, texts = (batch.column(i).slice(at, size) for i in range(3))
                for key, text in zip(zip(langs.to_pylist(), sources.to_pylist()), texts_of(texts)):
                    terms = (text or b"").translate(_TERM).split()
                    if terms:
                        n, docs = groups.setdefault(key, (Counter(), Counter()))
                        n.update(terms)
                        docs.update(set(terms))
                if sum(len(n) for n, _ in groups.values()) >= settings.held:
                    yield from rows()
        yield from rows()

    return docs.mapInArrow(task, COUNTED)


def share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / total), in decimals, so that no count is too large."""
    scaled = F.lit(SCALE).cast("decimal(18,0)") * (n + 1).cast("decimal(19,0)")
    return F.call_function("div", scaled, total.cast("decimal(19,0)")) + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def kept_terms(counted: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, source, n, lang_n, first): the counts of kept terms, with the language's count; first marks one row of each term. One shuffle, by language and term."""
    term = Window.partitionBy("lang", "term")
    per_source = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = per_source.withColumns({"lang_n": F.sum("n").over(term), "lang_docs": F.sum("docs").over(term), "first": F.col("source") == F.min("source").over(term)})
    return whole.where(F.col("lang_docs") >= min_docs).select("lang", F.col("term").cast("string").alias("term"), "source", "n", "lang_n", "first")


def group_facts(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """A row per group: number i within the language, v kept terms of it, total and lang_total (N + V of the group and of the language), p0 (its share of an absent term)."""
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum(F.col("first").cast("long")).alias("firsts"))
    whole = groups.join(sums, ["lang", "source"], "left").na.fill(0, ["n", "firsts"])
    lang = Window.partitionBy("lang")
    facts = whole.withColumns({"v": F.sum("firsts").over(lang), "lang_n": F.sum("n").over(lang), "i": F.row_number().over(lang.orderBy("source")) - 1})
    total = F.col("n") + F.col("v")
    p0 = F.when(F.col("v") > 0, share(F.lit(0), F.greatest(total, F.lit(1))))
    return facts.select("lang", "source", "i", "v", total.alias("total"), (F.col("lang_n") + F.col("v")).alias("lang_total"), F.coalesce(p0, F.lit(1)).alias("p0"))


def top_terms(kept: DataFrame, facts: DataFrame, top: int) -> DataFrame:
    """Part `term`: the terms whose share in the group exceeds the language's, by distance."""
    shares = kept.join(facts, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("total")).alias("p"), share(F.col("lang_n"), F.col("lang_total")).alias("q"))
    valued = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", distance(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return valued.withColumn("rank", rank).where(F.col("rank") <= top)


def exact(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def one_sided(kept: DataFrame, facts: DataFrame, others: DataFrame) -> DataFrame:
    """(lang, g, h, value): what the terms of one group add to its pairs, on either side, from histograms of its counts."""
    histogram = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("terms"))
    priced = histogram.join(facts, ["lang", "source"]).select("lang", "i", "terms", "p0", share(F.col("n"), F.col("total")).alias("p"))
    met = priced.join(others.select("lang", F.col("i").alias("j"), F.col("p0").alias("q0")), "lang").where("i != j")
    p, p0, q0, terms = map(F.col, ("p", "p0", "q0", "terms"))
    sums = met.groupBy("lang", "i", "j").agg(
        F.sum(exact(terms) * (distance(p, q0) - distance(p0, q0)).cast("decimal(19,0)")).alias("as_p"),
        F.sum(exact(terms) * (distance(q0, p) - distance(q0, p0)).cast("decimal(19,0)")).alias("as_q"),
    )
    return sums.select("lang", F.explode(F.array(F.struct(F.col("i").alias("g"), F.col("j").alias("h"), exact(F.col("as_p")).alias("value")), F.struct(F.col("j").alias("g"), F.col("i").alias("h"), exact(F.col("as_q")).alias("value")))).alias("x")).select("lang", "x.*")


def met_places(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows with so many entries on either side: row, left place and right place of each pair of a row's entries."""
    times = np.repeat(right, left)
    row, places = np.repeat(np.repeat(np.arange(len(left)), left), times), np.repeat(np.arange(len(times)), times)
    first = np.cumsum(times) - times
    return row, places, np.arange(len(places)) - first[places] + (np.cumsum(right) - right)[row]


def overlap(kept: DataFrame, facts: DataFrame, block: int) -> DataFrame:
    """(lang, g, h, value): the corrections of terms that both groups hold, from postings joined block by block."""
    entry = F.struct("i", share(F.col("n"), F.col("total")).alias("p"), "p0")
    postings = kept.join(facts, ["lang", "source"]).select("lang", "term", F.expr(f"i div {block}").cast("int").alias("block"), entry.alias("entry")).groupBy("lang", "term", "block").agg(F.collect_list("entry").alias("entries"))
    sides = [postings.select("lang", "term", F.col("block").alias(x), F.col("entries").alias(f"{x}s")) for x in "gh"]
    met = sides[0].join(sides[1], ["lang", "term"]).select("lang", "g", "h", "gs", "hs")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], np.ndarray] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, g, h), (high, low) in sums.items():
                at = np.flatnonzero((high != 0) | (low != 0))
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "g": (at // block + g * block).astype(np.int32), "h": (at % block + h * block).astype(np.int32), "high": high[at], "low": low[at]})
            sums.clear()

        def add(batch: pa.RecordBatch) -> None:
            keys = list(zip(*(batch.column(x).to_pylist() for x in ("lang", "g", "h"))))
            lists = [batch.column(x) for x in ("gs", "hs")]
            sizes = [x.value_lengths().to_numpy().astype(np.int64) for x in lists]
            (i, p, p0), (j, q, q0) = ([x.flatten().field(k).to_numpy().astype(np.int64) for k in ("i", "p", "p0")] for x in lists)
            row, a, b = met_places(*sizes)
            different = i[a] != j[b]
            row, a, b = row[different], a[different], b[different]
            f = lambda x, y: (x - y) ** 2 // y
            p, p0, q, q0 = p[a], p0[a], q[b], q0[b]
            value = f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)
            cell = (i[a] % block) * block + j[b] % block
            number = {k: n for n, k in enumerate(dict.fromkeys(keys))}
            of = np.array([number[k] for k in keys], np.int64)[row]
            for k, n in number.items():
                own = of == n
                high, low = sums.setdefault(k, np.zeros((2, block * block), np.int64))
                np.add.at(high, cell[own], value[own] >> 32)
                np.add.at(low, cell[own], value[own] & 0xFFFFFFFF)

        for batch in batches:
            pairs = np.cumsum(batch.column("gs").value_lengths().to_numpy().astype(np.int64) * batch.column("hs").value_lengths().to_numpy())
            at = 0
            while at < batch.num_rows:
                room = (pairs[at - 1] if at else 0) + 1_000_000
                size = max(1, int(np.searchsorted(pairs, room, "right")) - at)
                add(batch.slice(at, size))
                at += size
                if len(sums) > 32:
                    yield from rows()
        yield from rows()

    halves = met.mapInArrow(task, "lang string, g int, h int, high long, low long")
    return halves.select("lang", "g", "h", (exact(F.col("high")) * F.lit(2**32).cast("decimal(10,0)") + exact(F.col("low"))).cast("decimal(38,0)").alias("value"))


def source_pairs(kept: DataFrame, facts: DataFrame, few: DataFrame, block: int) -> DataFrame:
    """Part `pair`: every other source of the language, by the distance of all its shares. few is facts, marked for broadcast where small."""
    g = facts.select("lang", "source", F.col("i").alias("g"), F.col("p0").alias("p"), "v")
    h = few.select("lang", F.col("source").alias("item"), F.col("i").alias("h"), F.col("p0").alias("q"))
    absent = g.join(h, "lang").where("g != h").select("lang", "g", "h", exact(exact(F.col("v")) * distance(F.col("p"), F.col("q")).cast("decimal(19,0)")).alias("value"), "source", "item")
    none = F.lit(None).cast("string")
    parts = [x.select("lang", "g", "h", "value", none.alias("source"), none.alias("item")) for x in (one_sided(kept, few, few), overlap(kept, few, block))]
    sums = absent.union(parts[0]).union(parts[1]).groupBy("lang", "g", "h").agg(F.sum("value").cast("long").alias("value"), F.max("source").alias("source"), F.max("item").alias("item"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def audit(docs: DataFrame, settings: Settings = Settings(), text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value and rank of every group's pairs and foremost terms."""
    named = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text"))
    kept = checkpointed(kept_terms(counted_terms(named, settings), settings.min_docs))
    facts = checkpointed(group_facts(named.select("lang", "source").distinct(), kept))
    few = sized(facts, settings.few)
    return source_pairs(kept, facts, few, settings.block).unionByName(top_terms(kept, few, settings.top))
