"""Recorded books: living events are worked out once, replayed rows don't depend on batches."""

from pyspark.sql import functions as F

from ticklane.plans import stream_queries
from ticklane.streaming import books

SMALL = "/root/testdata/sf0.001"


def test_living_events_are_worked_out_once(spark):
    made = books.recorded(stream_queries.depth_feed(spark, SMALL).where("symbol < '3'"), 3, 120)
    assert "_broken" not in made._jdf.queryExecution().toString()


def test_rows_do_not_depend_on_batches_and_buckets(spark):
    feed = stream_queries.depth_feed(spark, SMALL).where("symbol < '3'")
    found = []
    for size, width in ((10_000, 120), (3, 120), (10_000, 7)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            found.append(sorted(map(str, books.recorded(feed, 2, width).select("symbol", "second", F.to_json(F.struct("bids", "asks"))).collect())))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] and found[0] == found[1] == found[2]
