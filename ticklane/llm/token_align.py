"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often each pair does.

Side A is a byte-level BPE file, side B a piece model with byte fallback. Both cut the bytes of space + text; a link is a
pair of token occurrences whose bytes overlap, a group what lies between two neighbouring places where both sides end a
token. Texts are encoded once, in units of a few megabytes, and written as

- facts: per document its counts and groups;
- links: per unit and stripe of B ids (id modulo the number of stripes) the entries (B id, A id, document, times);
- counts: the same summed over the documents of a task.

Counts go to their stripe and are added up (np.add.at) in a dense block, B ids of the stripe by A ids; row maxima give the
best count of each B id. Then links go to their stripe again, where the block scores them as they stream past; scores
return to their unit as one sum per document.

Hot ids: counts are summed before they move. A stripe with more than `task_links` links is scored in several slots; each
gets a copy of the stripe's counts, which the vocabularies bound, and a share of the units.

Rows: one output row per input row, whatever repeats. Texts that are null, empty or not restored by the bytes of either
side's tokens have no tokens: zeros and empty groups. Very long texts are encoded whole, as a unit of their own. Counts
that tie for the best are all best. An empty table gives an empty one. Only the id column of the input is kept, so other
columns cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import arrow_column, checkpointed, extend, slices, texts_of, vocabulary_path, written

COUNTS, LINKS, FACTS = 0, 1, 2
FACT = "struct<id: long, n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string>"
ENCODED = f"unit long, stripe int, kind int, n long, data binary, facts array<{FACT}>"
SCORED = f"unit long, data binary, facts array<{FACT}>"
ALIGNED = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
COUNTED = "stripe int, n long, data binary"
#: Letters and signs on whose classes all libraries' patterns agree (a test): Latin, and signs of common typography.
KNOWN = re.compile("[^\x00-ɏ‐-‧‰-›€]")


@dataclass(frozen=True)
class Settings:
    """The vocabulary files, B ids per stripe, bytes and documents of a unit, count entries that a task sums before they move, and links a slot scores."""

    a: str = "byte_bpe_50k.json"
    b: str = "piece_bpe_32k.model"
    stripe_ids: int = 512
    unit_bytes: int = 4_000_000
    unit_docs: int = 4096
    count_entries: int = 1_000_000
    task_links: int = 20_000_000


class ByteSide:
    """A byte-level BPE file. A faster encoder stands in for texts of known letters if the file's ids follow its merges."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, byte = spec["model"]["vocab"], {x: i for i, x in enumerate(byte_letters())}
        self.bytes = [b""] * (max([*vocab.values(), *(x["id"] for x in spec["added_tokens"])]) + 1)
        added = {x["id"]: x["content"].encode() for x in spec["added_tokens"]}
        for piece, i in vocab.items():
            self.bytes[i] = added[i] if i in added else bytes(byte[x] for x in piece)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        in_order = all(vocab[left + right] == 256 + i for i, (left, right) in enumerate(pairs))
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        ranks = {x: i for i, x in enumerate(self.bytes) if x and i not in added}
        self.quick = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if in_order else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.quick.encode_ordinary(" " + x) if self.quick and not KNOWN.search(x) else self.whole.encode(" " + x, add_special_tokens=False).ids for x in texts]


class PieceSide:
    """A piece model; it adds the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(self.model.id_to_piece(i), self.model.is_byte(i)) for i in range(self.model.vocab_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if is_byte else p.replace("▁", " ").encode() for p, is_byte in pieces]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Aligner:
    """Both sides, and the alignment of a few texts at once, as one long row of tokens."""

    def __init__(self, settings: Settings):
        self.a, self.b = ByteSide(vocabulary_path(settings.a)), PieceSide(vocabulary_path(settings.b))
        self.n_a, self.n_b = len(self.a.bytes), len(self.b.bytes)
        self.len_a, self.len_b = (np.array([*map(len, x.bytes)]) for x in (self.a, self.b))
        self.written = [f"{i}{end}" for n, ends in ((self.n_a, ",|"), (self.n_b, ",;")) for end in ends for i in range(n)]

    def tokens(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[list[int]], list[list[int]]]:
        """The numbers of the texts that both sides restore, and their ids."""
        able, given = [], []
        for i, x in enumerate(texts):
            try:
                if x:
                    given.append(x.decode())
                    able.append(i)
            except UnicodeDecodeError:
                continue
        sides = zip(able, self.a.encode(given), self.b.encode(given)) if given else ()
        same = lambda x, side, ids: b"".join(map(side.bytes.__getitem__, ids)) == b" " + x
        kept = [(i, a, b) for i, a, b in sides if same(texts[i], self.a, a) and same(texts[i], self.b, b)]
        return np.array([k[0] for k in kept], np.int64), [k[1] for k in kept], [k[2] for k in kept]

    def align(self, texts: list[bytes | None]) -> tuple[dict[str, np.ndarray], list[str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per text its counts and its groups, and of all links the text's number, the A id and the B id."""
        able, a, b = self.tokens(texts)
        counts = {k: np.zeros(len(texts), np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
        groups = [""] * len(texts)
        if not len(able):
            return counts, groups, (np.zeros(0, np.int64),) * 3
        ids_a, ids_b = (np.concatenate([np.array(x, np.int64) for x in side]) for side in (a, b))
        ends_a, ends_b = np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b])
        text_ends = np.cumsum([len(texts[i]) + 1 for i in able])
        ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")  # two sorted runs: one merge
        ends = ends[np.concatenate([ends[1:] != ends[:-1], [True]])]
        at_a, at_b, doc = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends), np.searchsorted(text_ends, ends)
        both = (ends_a[at_a] == ends) & (ends_b[at_b] == ends)
        counts["n_a"][able], counts["n_b"][able] = [*map(len, a)], [*map(len, b)]
        counts["n_links"][able] = np.bincount(doc, minlength=len(able))
        counts["n_groups"][able] = np.bincount(doc[both], minlength=len(able))
        group_ends = ends[both]
        group_a, group_b = np.searchsorted(group_ends, ends_a), np.searchsorted(group_ends, ends_b)
        text_a = ids_a + self.n_a * (group_ends[group_a] == ends_a)
        text_b = 2 * self.n_a + ids_b + self.n_b * (group_ends[group_b] == ends_b)
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        strings = [*map(self.written.__getitem__, np.concatenate([text_a, text_b])[order].tolist())]
        at = 0
        for i in able:
            n = int(counts["n_a"][i] + counts["n_b"][i])
            groups[i] = "".join(strings[at : at + n])[:-1]
            at += n
        return counts, groups, (able[doc], ids_a[at_a], ids_b[at_b])


def with_groups(docs: DataFrame, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """docs with groups, the aligned groups of ids as text: ids of one side joined by commas, | between the sides, ; between groups."""

    def start():
        aligner = Aligner(settings)
        return lambda texts: pa.array(aligner.align(texts_of(texts))[1], pa.string())

    return extend(docs, groups=arrow_column(start, "string")(F.col(text)))


class Stripes:
    """How B ids are dealt: id b stands in stripe b % n, at row b // n of its block."""

    def __init__(self, n_a: int, n_b: int, stripe_ids: int):
        self.n = max(1, -(-n_b // stripe_ids))
        self.rows, self.columns = -(-n_b // self.n), n_a

    def cells(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of the cells, those of one stripe side by side."""
        return ((b % self.n) * self.rows + b // self.n) * self.columns + a

    def cut(self, cells: np.ndarray) -> Iterator[tuple[int, slice]]:
        """The stripes that sorted cells fall in, each with its part."""
        size = self.rows * self.columns
        stripes = np.unique(cells // size)
        starts = np.searchsorted(cells, stripes * size)
        for s, start, end in zip(stripes.tolist(), starts.tolist(), [*starts[1:].tolist(), len(cells)]):
            yield s, slice(start, end)

    def block(self, total: int) -> np.ndarray:
        return np.zeros(self.rows * self.columns, np.int32 if total < 2**31 else np.int64)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, each in the fewest bytes that hold its values."""
    out = [len(arrays[0]).to_bytes(8, "little")]
    for x in arrays:
        kind = np.min_scalar_type(x.max()) if len(x) else np.dtype("u1")
        out += [bytes([kind.itemsize]), x.astype(kind).tobytes()]
    return b"".join(out)


def steps(cells: np.ndarray) -> np.ndarray:
    """Sorted cells as the first one and the steps between them; np.cumsum undoes it."""
    return np.diff(cells, prepend=0)


def unpacked(data: bytes) -> list[np.ndarray]:
    n, at, out = int.from_bytes(data[:8], "little"), 8, []
    while at < len(data):
        size = data[at]
        out.append(np.frombuffer(data, f"<u{size}", n, at + 1).astype(np.int64))
        at += 1 + n * size
    return out


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(values, starts) if len(starts) else values


def encoded(docs: DataFrame, settings: Settings, id: str, text: str) -> DataFrame:
    """Facts, links and counts of docs (see above)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(settings)
        stripes = Stripes(aligner.n_a, aligner.n_b, settings.stripe_ids)
        unit = TaskContext.get().partitionId() << 32
        facts: list[dict] = []
        links: list[tuple[np.ndarray, ...]] = []
        sums: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        fact_type = pa.struct([("id", pa.int64()), *((k, pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string())])
        schema = pa.schema([("unit", pa.int64()), ("stripe", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), ("data", pa.binary()), ("facts", pa.list_(fact_type))])

        def counted() -> pa.RecordBatch:
            cells, n = summed(np.concatenate([s[0] for s in sums]), np.concatenate([s[1] for s in sums]))
            sums.clear()
            rows = [{"unit": unit, "stripe": s, "kind": COUNTS, "n": int(n[part].sum()), "data": packed(steps(cells[part] - s * stripes.rows * stripes.columns), n[part]), "facts": None} for s, part in stripes.cut(cells)]
            return pa.RecordBatch.from_pylist(rows, schema)

        def unit_rows() -> pa.RecordBatch:
            doc, a, b = (np.concatenate([x[i] for x in links]) for i in range(3))
            keys, n = summed(stripes.cells(a, b) * len(facts) + doc, np.ones(len(doc), np.int64))
            cells, doc = keys // len(facts), keys % len(facts)
            rows = [{"unit": unit, "stripe": s, "kind": LINKS, "n": int(n[part].sum()), "data": packed(steps(cells[part] - s * stripes.rows * stripes.columns), doc[part], n[part]), "facts": None} for s, part in stripes.cut(cells)]
            sums.append(summed(cells, n))
            rows.append({"unit": unit, "stripe": None, "kind": FACTS, "n": len(facts), "data": None, "facts": list(facts)})
            facts.clear()
            links.clear()
            return pa.RecordBatch.from_pylist(rows, schema)

        for batch in batches:
            for at, rows in slices(batch.column(1)):
                texts, first = texts_of(batch.column(1).slice(at, rows)), len(facts)
                counts, groups, (doc, a, b) = aligner.align(texts)
                for i, x in enumerate(batch.column(0).slice(at, rows).to_pylist()):
                    facts.append({"id": x, **{k: int(v[i]) for k, v in counts.items()}, "groups_sha256": hashlib.sha256(groups[i].encode()).hexdigest() if groups[i] else ""})
                links.append((doc + first, a, b))
                size += sum(len(x or b"") for x in texts)
                if size >= settings.unit_bytes or len(facts) + 512 > settings.unit_docs:
                    yield unit_rows()
                    unit, size = unit + 1, 0
                    if sum(len(s[0]) for s in sums) >= settings.count_entries:
                        yield counted()
        if facts:
            yield unit_rows()
        if sums:
            yield counted()

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(task, ENCODED)


def dealt(df: DataFrame, place: str, slots: int, *order: str) -> DataFrame:
    """df with its places dealt to as many tasks as the session shuffles to, each place whole and sorted."""
    tasks = max(1, min(slots, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return df.repartitionById(tasks, (F.col(place) % tasks).cast("int")).sortWithinPartitions(place, *order)


def pair_counts(table: DataFrame, stripes: Stripes) -> DataFrame:
    """(stripe, n, data): all counts of a stripe, added up in its dense block and packed as the cells that occur. The vocabularies bound these rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None

        def row() -> pa.RecordBatch:
            cells = np.flatnonzero(block)
            n = block[cells].astype(np.int64)
            return pa.RecordBatch.from_pydict({"stripe": pa.array([now], pa.int32()), "n": [int(n.sum())], "data": [packed(steps(cells), n)]})

        for batch in batches:
            for s, data in zip(batch.column("stripe").to_pylist(), batch.column("data").to_pylist()):
                if s != now:
                    if now is not None:
                        yield row()
                    now, block = s, stripes.block(2**31)
                cells, n = unpacked(data)
                np.add.at(block, np.cumsum(cells), n)
        if now is not None:
            yield row()

    counts = table.where(F.col("kind") == COUNTS).select("stripe", "data")
    return dealt(counts, "stripe", stripes.n).mapInArrow(task, COUNTED)


def scores(table: DataFrame, counts: DataFrame, stripes: Stripes, task_links: int) -> DataFrame:
    """(unit, data): per unit and stripe the sums of its documents, links scored by the blocks made from counts (checkpointed, a row a stripe)."""
    parts = {r["stripe"]: -(-r["n"] // task_links) for r in counts.select("stripe", "n").collect()}
    firsts, slots = {}, 0
    for s in sorted(parts):
        firsts[s], slots = slots, slots + parts[s]
    if not slots:
        return table.select("unit", "data").limit(0)
    of = lambda values: F.create_map(*[F.lit(x) for pair in sorted(values.items()) for x in pair])[F.col("stripe")]
    copies = F.sequence(of(firsts), of(firsts) + of(parts) - 1)
    blocks = counts.select(F.explode(copies).alias("slot"), F.lit(-1).cast("long").alias("unit"), "data", "n")
    links = table.where(F.col("kind") == LINKS).select((of(firsts) + F.pmod(F.xxhash64("unit"), of(parts)).cast("int")).alias("slot"), "unit", "data", F.lit(0).cast("long").alias("n"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = best = None
        for batch in batches:
            units, made = [], []
            for unit, data, total in zip(*(batch.column(c).to_pylist() for c in ("unit", "data", "n"))):
                if unit < 0:
                    block = None  # before the next one is made
                    cells, n = unpacked(data)
                    block = stripes.block(total)
                    np.add.at(block, np.cumsum(cells), n.astype(block.dtype))
                    best = block.reshape(stripes.rows, stripes.columns).max(axis=1)
                    continue
                cells, doc, n = unpacked(data)
                cells = np.cumsum(cells)
                count = block[cells].astype(np.int64)
                is_best = count == best[cells // stripes.columns]
                docs, doc = np.unique(doc, return_inverse=True)
                of_best, of_all = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
                np.add.at(of_best, doc, n * is_best)
                np.add.at(of_all, doc, n * count)
                units.append(unit)
                made.append(packed(docs, of_best, of_all))
            if units:
                yield pa.RecordBatch.from_pydict({"unit": pa.array(units, pa.int64()), "data": pa.array(made, pa.binary())})

    return dealt(links.unionByName(blocks), "slot", slots, "unit").mapInArrow(task, "unit long, data binary")


def gathered(table: DataFrame, scored: DataFrame) -> DataFrame:
    """A row per document from the facts and all scores of its unit, unit by unit."""
    names = [x.split()[0] for x in ALIGNED.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, facts, best, total = None, None, None, None

        def rows() -> pa.RecordBatch:
            given = {k: facts.field(k) for k in names if k not in ("n_best", "count_sum")}
            return pa.RecordBatch.from_pydict({k: given[k] if k in given else best if k == "n_best" else total for k in names})

        for batch in batches:
            for i, (unit, data) in enumerate(zip(batch.column("unit").to_pylist(), batch.column("data").to_pylist())):
                if unit != now:
                    if now is not None:
                        yield rows()
                    found = batch.column("facts").slice(i, 1).flatten()  # a unit's facts come first
                    now, facts, best, total = unit, found, np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
                else:
                    docs, of_best, of_all = unpacked(data)
                    best[docs] += of_best
                    total[docs] += of_all
        if now is not None:
            yield rows()

    facts = table.where(F.col("kind") == FACTS).select("unit", "data", "facts")
    both = facts.unionByName(scored.select("unit", "data", F.lit(None).cast(f"array<{FACT}>").alias("facts")))
    return both.repartition("unit").sortWithinPartitions("unit", F.asc_nulls_first("data")).mapInArrow(task, ALIGNED)


def align(docs: DataFrame, settings: Settings = Settings(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document."""
    aligner = Aligner(settings)
    stripes = Stripes(aligner.n_a, aligner.n_b, settings.stripe_ids)
    table = written(encoded(docs, settings, id, text))
    counts = checkpointed(pair_counts(table, stripes))
    return gathered(table, scores(table, counts, stripes, settings.task_links)).withColumnRenamed("id", id)


def best_pairs(docs: DataFrame, settings: Settings = Settings(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """(b, a, n): for each B id that occurs the A ids linked with it most often, ties included, and how often."""
    aligner = Aligner(settings)
    stripes = Stripes(aligner.n_a, aligner.n_b, settings.stripe_ids)
    names = "b long, a long, n long"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, data in zip(batch.column("stripe").to_pylist(), batch.column("data").to_pylist()):
                cells, n = unpacked(data)
                cells = np.cumsum(cells)
                row = cells // stripes.columns
                best = np.zeros(stripes.rows, np.int64)
                np.maximum.at(best, row, n)
                top = n == best[row]
                yield pa.RecordBatch.from_pydict({"b": row[top] * stripes.n + s, "a": cells[top] % stripes.columns, "n": n[top]})

    return pair_counts(written(encoded(docs, settings, id, text)), stripes).select("stripe", "data").mapInArrow(task, names)
