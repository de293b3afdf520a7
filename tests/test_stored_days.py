"""Feeds written by day: files by days and bytes, not by symbols."""

import glob

from ticklane.sources import readers


def test_files_do_not_grow_with_symbols(spark, tmp_path):
    rows = spark.range(6000).selectExpr("concat('s', lpad(id % 1500, 4, '0')) as symbol", "timestamp_ntz'2024-01-01 01:00:00' + make_interval(0, 0, 0, id div 3000) as ts", "id as seq", "1.0D as price", "5L as size", "1 as exchange", "array(12) as conditions")
    readers.write_days(rows.repartition(4), f"{tmp_path}/trades")
    files = glob.glob(f"{tmp_path}/trades/day=*/*.parquet")
    assert len(files) == 2
    for f in files:
        stored = [r.symbol for r in spark.read.parquet(f).select("symbol").collect()]
        assert stored == sorted(stored) and len(stored) == 3000
    back = readers.trades(spark, f"{tmp_path}/trades").collect()
    assert {(r.symbol, r.seq) for r in back} == {(f"s{i % 1500:04d}", i) for i in range(6000)}
    readers.write_days(rows.limit(10), f"{tmp_path}/trades")
    assert readers.trades(spark, f"{tmp_path}/trades").count() == 6010
