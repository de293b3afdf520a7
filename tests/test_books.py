import pytest

from ticklane.streaming import books

UPDATES = "symbol string, first_id long, last_id long, previous_id long, bids array<array<string>>, asks array<array<string>>, event_ms long"
FETCHED = "symbol string, last_id long, bids array<array<string>>, asks array<array<string>>, event_ms long"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def feed(spark, updates, fetched):
    return books.events(spark.createDataFrame(updates, UPDATES), spark.createDataFrame(fetched, FETCHED))


def streamed(spark, tmp_path, name, parts, initial=None, levels=2):
    """Books of a stream that gets each part as a batch of its own, with the order in which they came out."""
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").json(f"{tmp_path}/{name}", ignoreNullFields=False)
        assert i < 9
    import glob
    import os

    for i, f in enumerate(sorted(glob.glob(f"{tmp_path}/{name}/*.json"), key=os.path.getmtime)):
        os.utime(f, (1_700_000_000 + 10 * i,) * 2)
    rows = spark.readStream.schema(books.EVENT).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/{name}")
    query = books.streamed(rows, initial, levels).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}-state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)
    return spark.table(name).collect()


def u(i, second, bids=(), asks=(), first=None, previous=None, symbol="x"):
    return (symbol, i if first is None else first, i, previous, [list(b) for b in bids], [list(a) for a in asks], second * 1000 + i)


def test_two_gaps_and_two_recoveries(spark, tmp_path, rocks):
    book = lambda i, *bids: ("x", i, [list(b) for b in bids], [["20", "1"]], 1000 + 200 * i)
    parts = [
        feed(spark, [u(3, 1, [("9", "9")]), u(6, 1, [("10", "5")], first=4), u(7, 2, [("9.50", "2")], previous=6), u(8, 2, [("10.0", "0")], previous=7)], []),  # the first is older than the book, the second straddles it
        feed(spark, [u(11, 3, [("1", "1")], previous=10), u(12, 4, [("2", "2")], previous=11)], []),  # a gap: nothing until a book
        feed(spark, [u(13, 5, [("3", "3")], previous=12)], [book(11, ("8", "8"))]),  # 12 and 13 follow the fetched book
        feed(spark, [u(20, 6, previous=18), u(31, 40, [("5", "1")], previous=30)], [book(30, ("6", "6"))]),
        feed(spark, [u(32, 90, [("5", "0")], previous=31), u(33, 200, previous=32)], []),
    ]
    initial = spark.createDataFrame([book(5, ("9", "1"))], FETCHED)
    rows = streamed(spark, tmp_path, "gaps", parts, initial)
    assert [(r.second, r.resynced, r.bids) for r in sorted(rows, key=lambda r: r.second)] == [
        (1, False, [[10.0, 5.0], [9.0, 1.0]]),
        (2, False, [[9.5, 2.0], [9.0, 1.0]]),
        (4, True, [[8.0, 8.0], [2.0, 2.0]]),
        (5, False, [[8.0, 8.0], [3.0, 3.0]]),
        (40, True, [[6.0, 6.0], [5.0, 1.0]]),
        (90, False, [[6.0, 6.0]]),
    ]
    assert all(r.asks == [[20.0, 1.0]] for r in rows)


def test_streamed_equals_recorded(spark, tmp_path, rocks):
    import random

    r = random.Random(8)
    updates, fetched = [], []
    for s in ("x", "y"):
        for i in range(1, 240):
            if i % 40 == 1:
                fetched.append((s, i, [["50", "1"], ["49", "2"]], [["60", "1"]], i * 400))
            if i % 31:
                updates.append((s, i, i, i - 1 if i % 2 else None, [[str(r.randrange(40, 55)), str(r.choice([0, 1, 2.5]))]], [[str(r.randrange(55, 70)), str(r.choice([0, 1, 4]))]], i * 400))
    whole = feed(spark, updates, fetched)
    cuts = [(0, 70), (70, 75), (75, 160), (160, 999)]
    parts = [whole.where(f"last_id >= {a} and last_id < {b}") for a, b in cuts]
    got = {(x.symbol, x.second, str(x.bids), str(x.asks)) for x in streamed(spark, tmp_path, "both", parts, levels=3)}
    for bucket in (5, 600):
        expected = {(x.symbol, x.second, str(x.bids), str(x.asks)) for x in books.recorded(whole.repartition(3), 3, bucket).collect()}
        late = {x for x in expected if x[1] > 95 - 11}
        assert len(expected) > 80 and got | late == expected | got and got - expected == set() and expected - late <= got


def test_events_without_a_book_or_updates(spark):
    only = feed(spark, [u(1, 1, [("1", "1")])], [])
    assert books.recorded(only).count() == 0
    assert books.recorded(feed(spark, [], [("x", 5, [["1", "1"]], None, 1)])).count() == 0
    one = feed(spark, [u(6, 3, [("2", "2")]), u(6, 3, [("2", "2")])], [("x", 5, [["1", "1"]], None, 1)])
    assert [(r.second, r.bids, r.asks) for r in books.recorded(one).collect()] == [(3, [[2.0, 2.0], [1.0, 1.0]], [])]
