"""The bar, trade and order-book operators on Structured Streaming. All take streaming or batch DataFrames."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Depth updates as sent, and their names here: U and u would be one name to Spark.
DEPTH = "symbol string, U long, u long, pu long, b array<array<string>>, a array<array<string>>, E long"
UPDATE = "struct<symbol:string,first_id:long,last_id:long,previous_id:long,bids:array<array<string>>,asks:array<array<string>>,event_ms:long>"


def parsed(messages: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """JSON messages as rows of the schema."""
    return messages.select(F.from_json(F.col(value).cast("string"), schema).alias("m")).select("m.*")


def depth_updates(messages: DataFrame, value: str = "value") -> DataFrame:
    """JSON depth messages (DEPTH) as rows of UPDATE; those without the first or last id are dropped."""
    return messages.select(F.from_json(F.col(value).cast("string"), DEPTH).cast(UPDATE).alias("m")).select("m.*").where("first_id is not null and last_id is not null")


def bars(trades: DataFrame, every: str = "1 minute", late: str = "10 seconds") -> DataFrame:
    """Bars per symbol and window of event time, final once the watermark has passed."""
    order = F.struct("ts", "seq")
    grouped = trades.withWatermark("ts", late).groupBy("symbol", F.window("ts", every).alias("w"))
    made = grouped.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"), F.try_divide(F.sum(F.col("price") * F.col("size")), F.sum("size").cast("double")).alias("vwap"), F.count("*").alias("trades"))
    return made.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "vwap", "trades")


def bursts(trades: DataFrame, gap: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Sessions of trades less than `gap` apart."""
    made = trades.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("size").alias("volume"))
    return made.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "volume")


def deduplicated(rows: DataFrame, keys: tuple[str, ...] = ("symbol", "trade_id"), late: str = "10 minutes") -> DataFrame:
    """Rows whose key was not seen within the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def appended(rows: DataFrame, path: str, checkpoint: str, every: str | None = "30 seconds", by: tuple[str, ...] = ("symbol",)) -> StreamingQuery:
    """A query that appends to Parquet; every None takes what is there and stops."""
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy(*by).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def merge_last(batch: DataFrame, path: str, staging: str, key: tuple[str, ...] = ("symbol", "ts"), order: str = "seq", by: tuple[str, ...] = ("symbol", "day")) -> None:
    """Merges a batch into the Parquet table at path: of each key the row of the greatest order stays, of equal ones the batch's.

    Only the partitions that the batch touches are read and written: the merged rows are staged, then put in their place. A batch that is
    merged again changes nothing. Keys lie within partitions.
    """
    spark = batch.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    rows = batch.withColumn("_new", F.lit(True))
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        stored = spark.read.schema(batch.schema).parquet(path).join(batch.select(*by).distinct(), list(by), "left_semi")
        rows = rows.unionByName(stored.withColumn("_new", F.lit(False)))
    names = [*dict.fromkeys((*by, *key))]
    rest = [c for c in batch.columns if c not in names]
    last = rows.groupBy(*names).agg(F.max_by(F.struct(*rest), F.struct(order, "_new")).alias("_r")).select(*names, "_r.*")
    last.write.mode("overwrite").parquet(staging)
    merged = spark.read.schema(last.schema).parquet(staging).select(*batch.columns)
    merged.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def kept_last(rows: DataFrame, path: str, checkpoint: str, key: tuple[str, ...] = ("symbol", "ts"), order: str = "seq", by: tuple[str, ...] = ("symbol", "day"), every: str | None = "30 seconds") -> StreamingQuery:
    """A query that merges each batch into Parquet by merge_last; batches that are run again after a failure leave the table as it was. every None takes what is there and stops."""

    def put(batch: DataFrame, number: int) -> None:
        merge_last(batch, path, f"{checkpoint.rstrip('/')}-staged", key, order, by)

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def book_snapshots(updates: DataFrame, levels: int = 10) -> DataFrame:
    """(symbol, second, gap, bids, asks): the book after the last update of each second, best levels first, from depth_updates.

    Updates are applied per symbol in order of last_id. An update that is older than the book is dropped; one that does not follow on it
    (previous_id, or without it first_id, must meet the last id) empties the book and gives a row with gap true. The state is one book.
    """
    state = "book string, last long"
    out = "symbol string, second long, gap boolean, bids array<array<double>>, asks array<array<double>>"

    def follow(key: tuple, batches: Iterator[pd.DataFrame], st: GroupState) -> Iterator[pd.DataFrame]:
        book, last = (json.loads(st.get[0]), st.get[1]) if st.exists else ({"bids": {}, "asks": {}}, None)
        rows: dict[int, list] = {}
        for m in pd.concat(batches).sort_values(["last_id", "first_id"]).itertuples(index=False):
            if last is not None and m.last_id <= last:
                continue
            follows = last is None or (m.previous_id == last if pd.notna(m.previous_id) else m.first_id <= last + 1 <= m.last_id)
            if not follows:
                book = {"bids": {}, "asks": {}}
            for side in ("bids", "asks"):
                for price, size in () if getattr(m, side) is None else getattr(m, side):
                    if float(size):
                        book[side][price] = float(size)
                    else:
                        book[side].pop(price, None)
            last, second = int(m.last_id), int(m.event_ms) // 1000
            best = {s: sorted(([float(p), q] for p, q in book[s].items()), reverse=s == "bids")[:levels] for s in ("bids", "asks")}
            rows[second] = [key[0], second, not follows or rows.get(second, [0, 0, False])[2], best["bids"], best["asks"]]
        st.update((json.dumps(book), last))
        yield pd.DataFrame(list(rows.values()), columns=["symbol", "second", "gap", "bids", "asks"])

    return updates.groupBy("symbol").applyInPandasWithState(follow, out, state, "append", GroupStateTimeout.NoTimeout)


def aligned_with_snapshot(updates: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Batch: buffered depth updates that go on from a fetched book (snapshots: symbol, last_id, bids, asks), the book itself as their first row.

    Updates that end before the snapshot are dropped. The first one kept must hold the id after the snapshot's; a symbol whose buffer begins later gives
    its snapshot alone, with gap true, and a new one has to be fetched.
    """
    base = snapshots.select("symbol", F.col("last_id").alias("_base"))  # one row per symbol
    newer = updates.join(base, "symbol").where(F.col("last_id") > F.col("_base"))
    first = newer.groupBy("symbol").agg(F.min(F.struct("last_id", "first_id", "_base")).alias("f"))
    gapped = first.select("symbol", (F.col("f.first_id") > F.col("f._base") + 1).alias("gap"))
    kept = newer.join(gapped.where("not gap"), "symbol").select(*updates.columns, "gap")
    book = snapshots.join(gapped, "symbol", "left").select("symbol", F.lit(0).cast("long").alias("first_id"), "last_id", F.lit(None).cast("long").alias("previous_id"), "bids", "asks", F.lit(0).cast("long").alias("event_ms"), F.coalesce("gap", F.lit(False)).alias("gap"))
    return book.unionByName(kept)


def book_at(changes: DataFrame, levels: int = 10) -> DataFrame:
    """Batch: (symbol, side, level, price, size) after all changes (symbol, side, price, size, seq): the last size of each price, zeros removed, best first."""
    last = changes.groupBy("symbol", "side", "price").agg(F.max_by("size", "seq").alias("size")).where("size > 0")
    level = F.row_number().over(Window.partitionBy("symbol", "side").orderBy(F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))))
    return last.withColumn("level", level).where(F.col("level") <= levels).select("symbol", "side", "level", "price", "size")


def sequence_gaps(updates: DataFrame) -> DataFrame:
    """Batch: updates that do not follow on the one before."""
    before = F.lag("last_id").over(Window.partitionBy("symbol").orderBy("last_id"))
    rows = updates.withColumn("_before", before).where("_before is not null")
    return rows.where(F.when(F.col("previous_id").isNotNull(), F.col("previous_id") != F.col("_before")).otherwise(F.col("first_id") > F.col("_before") + 1)).drop("_before")
