"""Helpers shared by the training-data operators."""

from __future__ import annotations

import importlib
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space, \t, \n, \v, \f, \r. ``bytes.split()`` splits on exactly these.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as decimal text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file: absolute paths stand for themselves, other names are looked up in the installed collection."""
    return name if "/" in name else importlib.import_module("public_tokenizers").path(name)


def texts_of(array: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of an Arrow string or binary array."""
    return (array if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else array.cast(pa.binary())).to_pylist()


#: Python code takes so many rows of a batch at a time, and about so many bytes of them, one row at least.
SLICE_ROWS, SLICE_BYTES = 512, 2_000_000


def slices(*arrays: pa.Array) -> Iterator[tuple[int, int]]:
    """Starts and lengths of the slices of a batch, given as the arrays that hold its bytes."""
    n = len(arrays[0])
    if n and sum(x.nbytes for x in arrays) <= SLICE_BYTES and n <= SLICE_ROWS:
        yield 0, n
        return
    lengths = [pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False) if pa.types.is_string(x.type) or pa.types.is_binary(x.type) else np.full(n, x.nbytes // max(n, 1)) for x in arrays]
    ends = np.cumsum(sum(x.astype(np.int64) for x in lengths))
    at = 0
    while at < n:
        room = (ends[at - 1] if at else 0) + SLICE_BYTES
        size = min(SLICE_ROWS, max(1, int(np.searchsorted(ends, room, "right")) - at), n - at)
        yield at, size
        at += size


def arrow_column(start: Callable[[], Callable[..., pa.Array]], returns: str, inputs: int = 1) -> Callable[..., Column]:
    """A column made in Python, slice by slice of a batch, so that the Python values of a few texts exist at a time: start() runs once per task and returns the function from the input arrays (one or two) to the output array."""

    def sliced(f: Callable[..., pa.Array], *arrays: pa.Array) -> pa.Array:
        made = [f(*(x.slice(at, n) for x in arrays)) for at, n in slices(*arrays)]
        return pa.concat_arrays(made) if made else f(*arrays)

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = start()
        for x in batches:
            yield sliced(f, x)

    def two(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        f = start()
        for x, y in batches:
            yield sliced(f, x, y)

    return F.arrow_udf(one if inputs == 1 else two, returns)


def extend(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns set; a column of the input with the same name (in any case) is replaced."""
    return df.withColumns(columns)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only a local session may lack it (tests, small runs) and gets a folder beside its warehouse."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}-checkpoints").rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed and written to the reliable checkpoint folder (see shared_folder), its lineage cut."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def sized(df: DataFrame, most: int) -> DataFrame:
    """df, a checkpointed table of narrow rows, to be broadcast if it was counted to have at most `most`; beyond that Spark's own join strategy holds."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """While it holds, tables that are computed send at most so many rows at once to Python: for rows of megabytes, whose batches the JVM and Python each hold whole."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class RecentCache(dict):
    """A memo of bounded size: two generations, the older one dropped when the newer one is full. make turns a list of keys into the list of their values."""

    def __init__(self, make: Callable[[list], list], limit: int = 250_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def many(self, keys: list) -> list:
        """The values of keys, in their order."""
        found = [*map(self.get, keys)]
        if None not in found:
            return found
        if len(self) + len(keys) > self.limit:
            self.old = dict(self)
            self.clear()
        old, new = self.old.get, {}
        for k, v in zip(keys, found):
            if v is None and k not in new:
                new[k] = old(k)
        absent = [k for k, v in new.items() if v is None]
        new.update(zip(absent, self.make(absent)))
        if len(new) <= self.limit:
            self.update((k, v) for k, v in new.items() if len(k) <= 100)
        return [new[k] if v is None else v for k, v in zip(keys, found)]


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """While it holds, the shuffle files of a query are removed when it ends, by Spark's own setting for it: for tables that are written and never computed again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """df as a table written to the shared folder and read again: compressed and columnar, so smaller than a checkpoint for wide or many rows. Each call makes a folder of its own, which is added to paths; remove() drops it once no result needs it any more."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that written() made."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        place = hadoop.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    paths.clear()
