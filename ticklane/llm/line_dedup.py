"""Line dedup: a line that many documents hold stays in one of them only.

Each line long enough to count gives a row (hash of its key, document, position). Hashes are range-partitioned and sorted
by hash, document from the largest down, and position; a pass along each range meets the document that keeps the line
first and gives the lines of all others. What comes back is no text but, for each document that loses a line, a compressed
bitmap of the lines it keeps.

Hot lines: before the shuffle, each run of rows settles what it can alone. Of a key that many documents of the run hold,
only the lines of the largest go to the key's range; the others are known to fall and travel spread by document. So a
range gets a few rows per key and run, however many documents share the line. Memory: a run of rows in numpy, and along a
range one document's lines of one key.

Rows: one output row per input row. A key is the line without white space at both ends and with A-Z lower-cased; it
counts from `min_chars` code points and `min_docs` documents on, and stays in the largest id that holds it (all its lines
there). Null and empty texts are one empty line. Rows that repeat an id are one document: each keeps or loses the same
keys. Rows without an id count for no line and lose none. Very long texts and lines are taken whole. Keys are told apart by
128-bit hashes. An empty table gives an empty one; input columns named like an output column are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, extend, slices, texts_of
from .textstats import SPACES, code_points

#: Undecided; undecided, but its key is known to stand in enough documents; known to fall.
OPEN, MANY, FALLS = 0, 1, 2
LINES = "h1 long, h2 long, id long, version long, position int, n_lines int, mark int"
FALLEN = "id long, version long, position int, n_lines int"


@dataclass(frozen=True)
class Settings:
    """Least code points of a key, least documents that hold it, and the rows a task settles at a time."""

    min_chars: int = 20
    min_docs: int = 3
    run_rows: int = 500_000


def keys_of(text: bytes) -> list[bytes]:
    return [line.strip(SPACES).lower() for line in text.split(b"\n")]


def counts(key: bytes, least: int) -> bool:
    """Whether the key has at least so many code points."""
    return len(key) >= least and (len(key) >= 4 * least or code_points(key) >= least)


def decided(rows: dict[str, np.ndarray], min_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by key and falling id: where keys start, whether each key stands in enough documents, and the key of each row."""
    n = len(rows["h1"])
    new_key = np.ones(n, bool)
    new_key[1:] = (rows["h1"][1:] != rows["h1"][:-1]) | (rows["h2"][1:] != rows["h2"][:-1])
    new_doc = new_key.copy()
    new_doc[1:] |= rows["id"][1:] != rows["id"][:-1]
    starts = np.flatnonzero(new_key)
    many = (np.add.reduceat(new_doc.astype(np.int64), starts) >= min_docs) | (np.maximum.reduceat(rows["mark"], starts) == MANY)
    return starts, many, np.cumsum(new_key) - 1


def settled(rows: dict[str, np.ndarray], min_docs: int) -> dict[str, np.ndarray]:
    """A run's rows with the marks that follow from the run alone; rows that fall get a hash of their document instead of the key's."""
    order = np.lexsort((rows["position"], ~rows["id"], rows["h2"], rows["h1"]))
    rows = {k: v[order] for k, v in rows.items()}
    starts, many, key = decided(rows, min_docs)
    falls = many[key] & (rows["id"] != rows["id"][starts][key])
    rows["mark"] = np.where(falls, FALLS, np.where(many[key], MANY, OPEN)).astype(np.int32)
    spread = (rows["id"] ^ rows["version"]) * np.int64(-7046029254386353131)
    rows["h1"], rows["h2"] = np.where(falls, spread, rows["h1"]), np.where(falls, 0, rows["h2"])
    return rows


def line_rows(docs: DataFrame, settings: Settings, id: str, text: str) -> DataFrame:
    """A row per line that counts, settled in runs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests: list[bytes] = []
        parts: list[np.ndarray] = []

        def run() -> pa.RecordBatch:
            hashes = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            of = np.concatenate(parts, axis=1)
            rows = {"h1": hashes[:, 0], "h2": hashes[:, 1], "id": of[0], "version": of[1], "position": of[2].astype(np.int32), "n_lines": of[3].astype(np.int32), "mark": np.zeros(len(hashes), np.int32)}
            digests.clear()
            parts.clear()
            return pa.RecordBatch.from_pydict(settled(rows, settings.min_docs))

        for batch in batches:
            for at, size in slices(batch.column(1)):
                ids, texts, versions = (batch.column(i).slice(at, size) for i in range(3))
                for i, t, v in zip(ids.to_pylist(), texts_of(texts), versions.to_pylist()):
                    keys = keys_of(t or b"")
                    places = [p for p, k in enumerate(keys) if counts(k, settings.min_chars)]
                    if places:
                        digests += [xxhash.xxh3_128_digest(keys[p]) for p in places]
                        own = np.empty((4, len(places)), np.int64)
                        own[0], own[1], own[2], own[3] = i, v, places, len(keys)
                        parts.append(own)
                    if len(digests) >= settings.run_rows:
                        yield run()
        if digests:
            yield run()

    lines = docs.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("version"))
    return lines.mapInArrow(task, LINES)


def fallen_lines(lines: DataFrame, settings: Settings) -> DataFrame:
    """The lines that fall, from one pass along each range of hashes."""
    ranges = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.least(F.floor((F.col("h1") / 2.0**64 + 0.5) * ranges), F.lit(ranges - 1)).cast("int")
    names = [x.split()[0] for x in LINES.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # of the key that the next batch may go on with: its first row and, while it may still stay, those of its second document
        for batch in batches:
            rows = {k: batch.column(k).to_numpy() for k in names}
            known = rows["mark"] == FALLS
            given = [{k: v[known] for k, v in rows.items()}]
            rows = {k: v[~known] for k, v in rows.items()}
            if held is not None:
                rows = {k: np.concatenate([held[k], v]) for k, v in rows.items()}
            if len(rows["h1"]):
                starts, many, key = decided(rows, settings.min_docs)
                top = rows["id"][starts][key]
                falls = many[key] & (rows["id"] != top)
                given.append({k: v[falls] for k, v in rows.items()})
                last = key == len(starts) - 1
                rest = np.flatnonzero(last & ~falls & (rows["id"] != top))
                rest = np.concatenate([starts[-1:], rest])
                held = {k: v[rest] for k, v in rows.items()}
                held["mark"] = np.full(len(rest), MANY if many[-1] else OPEN, np.int32)
            out = {k: np.concatenate([g[k] for g in given]) for k in ("id", "version", "position", "n_lines")}
            if len(out["id"]):
                yield pa.RecordBatch.from_pydict(out)

    ordered = lines.repartitionById(ranges, place).sortWithinPartitions("h1", "h2", F.desc("id"), "position")
    return ordered.mapInArrow(task, FALLEN)


def packed(positions: np.ndarray, n_lines: int) -> bytes:
    """The compressed bitmap of the lines kept."""
    keep = np.ones(n_lines, np.uint8)
    keep[positions] = 0
    return zlib.compress(np.packbits(keep).tobytes())


def unpacked(keep: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines)


def keep_bitmaps(docs: DataFrame, settings: Settings = Settings(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, version, n_lines, n_dropped, keep) of the texts that lose lines; texts without a row keep all theirs. version is xxhash64 of the text, which tells different texts of one id apart; keep is read by unpacked()."""

    def start():
        def batch(positions: pa.Array, n_lines: pa.Array) -> pa.Array:
            return pa.array([packed(np.asarray(p.values), n) for p, n in zip(positions, n_lines.to_pylist())], pa.binary())

        return batch

    fallen = fallen_lines(line_rows(docs, settings, id, text), settings)
    each = fallen.groupBy("id", "version").agg(F.first("n_lines").alias("n_lines"), F.collect_set("position").alias("positions"))
    return each.select(F.col("id").alias(id), "version", F.col("n_lines").cast("long").alias("n_lines"), F.size("positions").cast("long").alias("n_dropped"), arrow_column(start, "binary", 2)("positions", "n_lines").alias("keep"))


def with_kept(docs: DataFrame, bitmaps: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_lines (before dropping), n_dropped and kept_text."""

    def start():
        def kept(t: bytes | None, keep: bytes | None) -> bytes:
            if keep is None or t is None:
                return t or b""
            lines = t.split(b"\n")
            return b"\n".join(compress(lines, unpacked(keep, len(lines)).tolist()))

        return lambda texts, keeps: pa.array(list(map(kept, texts_of(texts), keeps.to_pylist())), pa.binary())

    marks = bitmaps.select(F.col(id).alias("_line_id"), F.col("version").alias("_line_version"), F.col("n_dropped").alias("_line_dropped"), F.col("keep").alias("_line_keep"))
    joined = docs.join(marks, (docs[id].cast("long") == F.col("_line_id")) & (F.xxhash64(docs[text]) == F.col("_line_version")), "left")
    whole = F.coalesce(docs[text], F.lit(""))
    n_lines = F.length(whole) - F.length(F.translate(whole, "\n", "")) + 1
    made = extend(joined, n_lines=n_lines.cast("long"), n_dropped=F.coalesce("_line_dropped", F.lit(0)).cast("long"), kept_text=arrow_column(start, "binary", 2)(docs[text], F.col("_line_keep")).cast("string"))
    return made.drop("_line_id", "_line_version", "_line_dropped", "_line_keep")


def drop_repeated(docs: DataFrame, settings: Settings = Settings(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_lines, n_dropped and kept_text, the text without the lines that other documents keep."""
    return with_kept(docs, keep_bitmaps(docs, settings, id, text), id, text)
