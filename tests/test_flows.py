import json

import pytest
from pyspark.sql import functions as F

from ticklane.sources import readers
from ticklane.streaming import flows


def test_streamed_bars_equal_batch_bars(spark, tmp_path):
    rows = spark.range(600).selectExpr("concat('s', id % 2) as symbol", "timestamp_seconds(1700000000 + id * 7) as ts", "id as seq", "cast(id % 13 as double) + 1 as price", "id % 5 + 1 as size")
    rows.write.parquet(f"{tmp_path}/in")
    stream = flows.bars(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    flows.appended(stream, f"{tmp_path}/out", f"{tmp_path}/state", every=None).awaitTermination(120)
    got, all_bars = spark.read.parquet(f"{tmp_path}/out"), flows.bars(rows)
    columns = sorted(got.columns)
    # All windows that ended before the last event less the watermark's ten seconds are final, and no others.
    final = all_bars.where(F.unix_timestamp("ts") + 60 <= rows.agg(F.max(F.unix_timestamp("ts"))).first()[0] - 10).select(*columns)
    assert got.count() == final.count() > 100
    assert got.select(*columns).exceptAll(final).count() == 0


def test_order_book_from_updates_and_gaps(spark, tmp_path):
    m = lambda U, u, pu, b, a, E: json.dumps({"symbol": "x", "U": U, "u": u, "pu": pu, "b": b, "a": a, "E": E})
    updates = [m(1, 2, None, [["10", "1"], ["9", "2"]], [["11", "3"]], 1000), m(3, 4, 2, [["10", "0"]], [["12", "1"]], 1500), m(8, 9, 7, [["8", "5"]], [], 2100), '{"symbol": "x", "b": [], "a": []}']
    spark.createDataFrame([(u,) for u in updates], "value string").coalesce(1).write.text(f"{tmp_path}/in")
    parsed = flows.depth_updates(spark.readStream.text(f"{tmp_path}/in"))
    query = flows.book_snapshots(parsed, 2).writeStream.format("memory").queryName("books").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.second: (r.gap, r.bids, r.asks) for r in spark.table("books").collect()}
    assert got == {1: (False, [[9.0, 2.0]], [[11.0, 3.0], [12.0, 1.0]]), 2: (True, [[8.0, 5.0]], [])}
    assert [r.first_id for r in flows.sequence_gaps(flows.depth_updates(spark.read.text(f"{tmp_path}/in"))).collect()] == [8]


def test_messages_without_a_side_and_a_book_after_a_gap(spark, tmp_path):
    m = lambda u, pu, **sides: json.dumps({"symbol": "x", "U": u, "u": u, "pu": pu, "E": 1000 * u} | sides)
    texts = [m(1, None, b=[["10", "1"]]), m(2, 1, a=[["11", "2"]]), m(5, 4, b=[["9", "1"]])]
    spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1).write.text(f"{tmp_path}/in")
    parsed = flows.depth_updates(spark.readStream.text(f"{tmp_path}/in"))
    flows.book_snapshots(parsed, 2).writeStream.format("memory").queryName("sided").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(120)
    got = {r.second: (r.gap, r.bids, r.asks) for r in spark.table("sided").collect()}
    assert got == {1: (False, [[10.0, 1.0]], []), 2: (False, [[10.0, 1.0]], [[11.0, 2.0]]), 5: (True, [[9.0, 1.0]], [])}
    updates = flows.depth_updates(spark.read.text(f"{tmp_path}/in"))
    book = lambda k: spark.createDataFrame([("x", k, [["8", "1"]], [])], "symbol string, last_id long, bids array<array<string>>, asks array<array<string>>")
    aligned = lambda k: sorted((r.last_id, r.gap) for r in flows.aligned_with_snapshot(updates, book(k)).collect())
    assert aligned(1) == [(1, False), (2, False), (5, False)] and aligned(3) == [(3, True)] and aligned(9) == [(9, False)]


def test_readers_round_trip_ranges_and_conditions(spark, tmp_path):
    rows = spark.sql("select 'a' as symbol, timestamp_ntz'2024-01-01 10:00:00' as ts, 1L as seq, 2.0D as price, 3L as size, 4 as exchange, array(12) as conditions union all select 'a', timestamp_ntz'2024-01-02 10:00:00', 2L, double('nan'), 3L, 4, array(12, 37) union all select 'a', timestamp_ntz'2024-01-03 10:00:00', 3L, 5.0D, 3L, 4, null")
    readers.write_days(rows, f"{tmp_path}/trades")
    assert readers.trades(spark, f"{tmp_path}/trades").count() == 2
    got = readers.trades(spark, f"{tmp_path}/trades", "2024-01-02", "2024-01-03", regular=False).collect()
    assert [(r.seq, r.price) for r in got] == [(2, None)]
    assert readers.days(spark, "2024-01-30", "2024-02-02").count() == 4


def test_standard_names_and_nested_books(spark, tmp_path):
    bars = spark.createDataFrame([("a", 1700000000000, "1", "3", "0.5", "x", 10.0, 1.5, 4)], "symbol string, t long, o string, h string, l string, c string, v double, vw double, n int")
    r = readers.standard_bars(bars).first()
    assert (str(r.ts), r.open, r.close, r.trades) == ("2023-11-14 22:13:20", 1.0, None, 4)
    ticks = spark.createDataFrame([(None, 1700000000123456789)], "sip_timestamp long, participant_timestamp long")
    assert str(readers.standard_ticks(ticks).first().ts) == "2023-11-14 22:13:20.123456"
    with pytest.raises(ValueError):
        readers.standard_ticks(ticks.select(F.lit(1).alias("x")))
    spark.createDataFrame([([[10.0, 1.0], [10.5, 2.0]], [[11.0, 1.0]])], "bids array<array<double>>, asks array<array<double>>").write.parquet(f"{tmp_path}/book")
    b = readers.book(spark, f"{tmp_path}/book", 2, nested=True).first()
    assert (b.bid_price_1, b.bid_price_2, b.bid_volume_2, b.ask_price_2) == (10.0, None, None, None)


def test_a_sink_keeps_the_last_row_of_a_key_and_replays_change_nothing(spark, tmp_path):
    path, schema = f"{tmp_path}/last", "symbol string, day string, ts long, seq long, price double"
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    stored = lambda: sorted(tuple(r[c] for c in ("symbol", "day", "ts", "seq", "price")) for r in spark.read.schema(schema).parquet(path).collect())
    first = batch(("a", "d1", 1, 1, 10.0), ("a", "d1", 1, 2, 11.0), ("a", "d2", 5, 1, 12.0), ("b", "d1", 1, 1, 13.0))
    second = batch(("a", "d1", 1, 2, 20.0), ("a", "d1", 2, 1, None), ("b", "d1", 1, 0, 99.0))
    flows.merge_last(first, path, f"{tmp_path}/staged")
    assert stored() == [("a", "d1", 1, 2, 11.0), ("a", "d2", 5, 1, 12.0), ("b", "d1", 1, 1, 13.0)]
    for _ in range(2):
        flows.merge_last(second, path, f"{tmp_path}/staged")
        assert stored() == [("a", "d1", 1, 2, 20.0), ("a", "d1", 2, 1, None), ("a", "d2", 5, 1, 12.0), ("b", "d1", 1, 1, 13.0)]


def test_streamed_rows_are_merged(spark, tmp_path):
    schema = "symbol string, day string, ts long, seq long, price double"
    for seq in (1, 2, 3):
        spark.createDataFrame([("a", "d", t, seq, float(seq)) for t in range(4 - seq)], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    flows.kept_last(rows, f"{tmp_path}/out", f"{tmp_path}/state", every=None).awaitTermination(200)
    assert sorted((r.ts, r.seq) for r in spark.read.schema(schema).parquet(f"{tmp_path}/out").collect()) == [(0, 3), (1, 2), (2, 1)]
