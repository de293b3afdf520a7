"""Order books that start from a fetched snapshot, follow the depth updates and recover after a gap; streamed, and in batch over recorded events.

Events are depth updates (flows.UPDATE) and fetched books under one schema (EVENT): of a book, last_id is the id it stands at
and bids and asks hold all its levels. A book takes the updates beyond its id: the first must hold the id that follows
(first_id <= id + 1 <= last_id); each later one must name the last id before it (previous_id), or without that hold the id
that follows. What does not follow ends the book: there are no rows until a newer fetched book. Updates that come before
their book wait for it. Rows give the best levels after the last update of each second.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from heapq import nlargest, nsmallest
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.lineage import new_path

SIDES = ("bids", "asks")
EVENT = "symbol string, snapshot boolean, first_id long, last_id long, previous_id long, bids array<array<string>>, asks array<array<string>>, event_ms long"
BOOKS = "symbol string, second long, resynced boolean, bids array<array<double>>, asks array<array<double>>"
WAITING = "first_id long, last_id long, previous_id long, bids array<array<string>>, asks array<array<string>>, event_ms long"


def events(updates: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Updates and fetched books (symbol, last_id, bids, asks, event_ms) as one table of EVENT."""
    books = snapshots.selectExpr("symbol", "true as snapshot", "cast(null as long) as first_id", "last_id", "cast(null as long) as previous_id", "bids", "asks", "event_ms")
    return updates.withColumn("snapshot", F.lit(False)).select(*books.columns).union(books)


def follows(event: Any, last: int, fresh: bool) -> bool:
    """Whether an update goes on from a book at id `last`; fresh: no update has been applied to it yet."""
    if not fresh and event.previous_id is not None:
        return event.previous_id == last
    return event.first_id <= last + 1 <= event.last_id


def changes(event: Any) -> Iterator[tuple[str, float, float]]:
    for side in SIDES:
        for price, size in getattr(event, side) or ():
            yield side, float(price), float(size)


def best(sizes: dict[tuple[str, float], float], levels: int) -> list[list[list[float]]]:
    """Bids from the highest, asks from the lowest price, without sorting the whole book."""
    found = []
    for side, pick in zip(SIDES, (nlargest, nsmallest)):
        found.append([[p, sizes[side, p]] for p in pick(levels, (p for s, p in sizes if s == side))])
    return found


class BookProcessor(StatefulProcessor):
    """State per symbol: the size of each side and price (a map, of which only changed levels are written), where the book stands, and updates that wait for a fetched book."""

    def __init__(self, levels: int, waiting: int):
        self.levels, self.most = levels, waiting

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sizes = handle.getMapState("sizes", "side string, price double", "size double")
        self.status = handle.getValueState("status", "last long, live boolean, fresh boolean, resynced boolean, second long")
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        for side, price, size in changes(initialState):
            if size:
                self.sizes.updateValue((side, price), (size,))
        self.status.update((initialState.last_id, True, True, False, None))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        book = {(k[0], k[1]): v[0] for k, v in self.sizes.iterator()}
        last, live, fresh, resynced, second = self.status.get() if self.status.exists() else (None, False, True, False, None)
        waiting = [Row(*WAITING_NAMES)(*w) for w in self.waiting.get()] if self.waiting.exists() else []
        stored, changed = dict(book), set()
        queue = sorted(rows, key=lambda e: (e.last_id, bool(e.snapshot)))
        out: list[Row] = []

        def put(side: str, price: float, size: float) -> None:
            changed.add((side, price))
            if size:
                book[side, price] = size
            else:
                book.pop((side, price), None)

        def shown() -> Row:
            return Row(symbol=key[0], second=second, resynced=resynced, **dict(zip(SIDES, best(book, self.levels))))

        for e in queue:
            if e.snapshot:
                if live and e.last_id < last:
                    continue
                if second is not None:
                    out.append(shown())
                resynced, second = last is not None, None
                changed.update(book)
                book.clear()
                for level in changes(e):
                    put(*level)
                last, live, fresh = e.last_id, True, True
                due, waiting = [w for w in waiting if w.last_id > last], []
            else:
                due = [e]
            for u in due:
                if not live:
                    waiting.append(u)
                elif u.last_id > last:
                    if not follows(u, last, fresh):
                        if second is not None:
                            out.append(shown())
                        changed.update(book)
                        book.clear()
                        live, second = False, None
                        waiting.append(u)
                        continue
                    if second is not None and u.event_ms // 1000 > second:
                        out.append(shown())
                        resynced = False
                    second = u.event_ms // 1000 if second is None else max(second, u.event_ms // 1000)
                    for level in changes(u):
                        put(*level)
                    last, fresh = u.last_id, False
        for k in changed:
            if k in book:
                if stored.get(k) != book[k]:
                    self.sizes.updateValue(k, (book[k],))
            elif k in stored:
                self.sizes.removeKey(k)
        self.status.update((last, live, fresh, resynced, second))
        waiting = sorted(waiting, key=lambda w: w.last_id)[-self.most :]
        if waiting:
            self.waiting.put([tuple(w[x] for x in WAITING_NAMES) for w in waiting])
        elif self.waiting.exists():
            self.waiting.clear()
        if second is not None:
            self.handle.registerTimer((second + 1) * 1000)
        yield from out

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        """The second's end has passed the watermark and no later update has come."""
        last, live, fresh, resynced, second = self.status.get()
        if second is not None and (second + 1) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            book = {(k[0], k[1]): v[0] for k, v in self.sizes.iterator()}
            self.status.update((last, live, fresh, False, None))
            yield Row(symbol=key[0], second=second, resynced=resynced, **dict(zip(SIDES, best(book, self.levels))))

    def close(self) -> None:
        pass


WAITING_NAMES = tuple(x.split()[0] for x in WAITING.split(", "))


def streamed(rows: DataFrame, initial: DataFrame | None = None, levels: int = 10, late: str = "10 seconds", waiting: int = 100_000) -> DataFrame:
    """Books by second (BOOKS) of a stream of EVENT, each once: when a later update comes or the watermark passes the second's end.

    initial: the books to start from, (symbol, last_id, bids, asks), one row per symbol. resynced marks a book's first row after a gap or
    a newer fetched book. Of updates that wait for a book the newest `waiting` stay. Events older than the
    watermark are dropped, so a fetched book must carry the time at which it was fetched. A symbol's events of one batch are applied by
    id. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    timed = rows.withColumn("ts", F.timestamp_millis("event_ms")).withWatermark("ts", late)
    start = None if initial is None else initial.select("symbol", "last_id", "bids", "asks").groupBy("symbol")
    return timed.groupBy("symbol").transformWithState(BookProcessor(levels, waiting), BOOKS, "append", "EventTime", start)


def lived(rows: DataFrame) -> DataFrame:
    """Batch: the events of books while they live, with epoch, the id of the fetched book they follow; books themselves included.

    Two windows: by symbol over ids for the epoch, by epoch for what follows. Updates without a book before them, and all from an epoch's
    first gap on, are left out.
    """
    order = Window.partitionBy("symbol").orderBy("last_id", F.col("snapshot").cast("int"))
    before = F.last(F.when(F.col("snapshot"), F.col("last_id")), ignorenulls=True)
    of = rows.withColumn("epoch", F.when(F.col("snapshot"), F.col("last_id")).otherwise(before.over(order.rowsBetween(Window.unboundedPreceding, -1))))
    kept = of.where(F.col("epoch").isNotNull() & (F.col("snapshot") | (F.col("last_id") > F.col("epoch"))))
    steps = Window.partitionBy("symbol", "epoch").orderBy((~F.col("snapshot")).cast("int"), "last_id", "first_id")
    last, was_book = F.lag("last_id").over(steps), F.lag("snapshot").over(steps)
    holds = (F.col("first_id") <= F.col("_last") + 1) & (F.col("_last") + 1 <= F.col("last_id"))
    goes_on = F.col("snapshot") | F.when(~F.col("_fresh") & F.col("previous_id").isNotNull(), F.col("previous_id") == F.col("_last")).otherwise(holds)
    checked = kept.withColumns({"_last": last, "_fresh": was_book}).withColumn("_broken", F.coalesce(~goes_on, F.lit(True)))
    ended = F.max("_broken").over(steps.rowsBetween(Window.unboundedPreceding, 0))
    return checked.withColumn("_broken", ended).where("not _broken").drop("_last", "_fresh", "_broken")


def side_levels(side: str) -> Column:
    """The levels of one side as structs of side, price and size."""
    given = F.coalesce(F.col(side), F.array().cast("array<array<string>>"))
    return F.transform(given, lambda x: F.struct(F.lit(side).alias("side"), x[0].cast("double").alias("price"), x[1].cast("double").alias("size")))


class Shown:
    """Rows of best levels by column: symbol, second, and of each side the number of levels and their prices and sizes in turn."""

    def __init__(self, levels: int):
        self.levels = levels
        self.clear()

    def clear(self) -> None:
        self.symbols, self.seconds, self.counts, self.flat = [], [], ([], []), ([], [])

    def add(self, symbol: str | None, second: int, books: tuple[dict[float, float], dict[float, float]]) -> None:
        self.symbols.append(symbol)
        self.seconds.append(second)
        for book, pick, counts, flat in zip(books, (nlargest, nsmallest), self.counts, self.flat):
            found = pick(self.levels, book)
            counts.append(len(found))
            for p in found:
                flat += (p, book[p])

    def taken(self) -> pa.RecordBatch:
        sides = []
        for counts, flat in zip(self.counts, self.flat):
            pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 2), pa.int32()), pa.array(flat, pa.float64()))
            sides.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pairs))
        made = pa.record_batch([pa.array(self.symbols, pa.string()), pa.array(self.seconds, pa.int64()), *sides], ["symbol", "second", *SIDES])
        self.clear()
        return made


def recorded(rows: DataFrame, levels: int = 10, bucket_seconds: int = 600) -> DataFrame:
    """Batch: books by second (BOOKS without resynced) of recorded EVENTs.

    Each price's changes are intervals of time; a bucket of seconds starts from the levels that stand at its beginning and is
    replayed alone, so a symbol is spread over as many tasks as it has buckets. Ids that repeat count once. The events of living books
    are written once, to the shared folder, and read by each step.
    """
    alive = lived(rows.dropDuplicates(["symbol", "snapshot", "last_id"])).withColumn("second", F.expr("event_ms div 1000"))
    epoch = Window.partitionBy("symbol", "epoch")
    told = F.when(~F.col("snapshot"), F.col("second"))
    reached = F.max(told).over(epoch.orderBy((~F.col("snapshot")).cast("int"), "last_id").rowsBetween(Window.unboundedPreceding, 0))
    placed = alive.withColumn("_reached", reached).withColumn("second", F.coalesce("_reached", F.min("_reached").over(epoch))).where("second is not null").drop("_reached").withColumn("bucket", F.expr(f"second div {bucket_seconds}"))
    path = new_path(rows.sparkSession)
    placed.write.parquet(path)
    placed = rows.sparkSession.read.parquet(path)
    sides = F.concat(*map(side_levels, SIDES))
    keys = ["symbol", "epoch", "bucket"]
    steps = placed.select(*keys, "snapshot", "last_id", "second", F.posexplode_outer(sides).alias("n", "level")).select(*keys, "snapshot", "last_id", "second", "n", "level.*")
    latest = steps.where("price is not null").groupBy(*keys, "side", "price").agg(F.max_by("size", F.struct("last_id", "n")).alias("size"))
    until = F.lead("bucket").over(Window.partitionBy("symbol", "epoch", "side", "price").orderBy("bucket"))
    last_bucket = placed.groupBy("symbol", "epoch").agg(F.max("bucket").alias("end"))
    spans = latest.withColumn("until", until).where("size > 0").join(last_bucket, ["symbol", "epoch"]).withColumn("until", F.coalesce("until", "end")).where("until > bucket")
    begun = spans.select("symbol", "epoch", F.explode(F.sequence(F.col("bucket") + 1, "until")).alias("bucket"), F.lit(True).alias("snapshot"), F.lit(-1).cast("long").alias("last_id"), F.lit(None).cast("long").alias("second"), F.lit(0).alias("n"), "side", "price", "size")
    busy = placed.where("not snapshot").select(*keys).distinct()
    whole = steps.unionByName(begun.join(busy, keys, "left_semi"))
    ordered = whole.repartition(*keys).sortWithinPartitions(*keys, (~F.col("snapshot")).cast("int"), "last_id", "n")

    def replay(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, second, books = None, None, ({}, {})
        out = Shown(levels)
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("symbol").dictionary_encode()
            code = names.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            symbols, epochs, buckets = names.to_pylist(), *(batch.column(c).to_pylist() for c in keys[1:])
            moves = np.ones(batch.num_rows, bool)
            moves[1:] = np.any([np.diff(v) != 0 for v in (code, *(batch.column(c).to_numpy() for c in keys[1:]))], 0)
            moves[0] = (symbols[0], epochs[0], buckets[0]) != now
            columns = [batch.column(c).to_pylist() for c in ("snapshot", "second", "price", "size")]
            bids = pc.equal(batch.column("side"), "bids").to_pylist()
            for k, (moved, snapshot, at, price, size, bid) in enumerate(zip(moves.tolist(), *columns, bids)):
                if second is not None and (moved or (not snapshot and at > second)):
                    out.add(now[0], second, books)
                    second = None
                if moved:
                    now, books = (symbols[k], epochs[k], buckets[k]), ({}, {})
                if price is not None:
                    if size:
                        books[0 if bid else 1][price] = size
                    else:
                        books[0 if bid else 1].pop(price, None)
                if not snapshot:
                    second = at
            if out.seconds:
                yield out.taken()
        if second is not None:
            out.add(now[0], second, books)
            yield out.taken()

    return ordered.mapInArrow(replay, "symbol string, second long, bids array<array<double>>, asks array<array<double>>")
