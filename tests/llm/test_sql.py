"""The queries with SQL give the SQL's rows on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

from ticklane.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    got = queries.QUERIES[name](spark, SMALL).toPandas()
    expected = con.execute(queries.ORACLE_SQL[name]).df()[list(got.columns)]
    assert list(map(tuple, got.sort_values(list(got.columns)).to_numpy())) == list(map(tuple, expected.sort_values(list(got.columns)).to_numpy()))


def test_links_of_stored_vectors_equal_sql(spark, tmp_path):
    """The stored tables' vectors have no links; these have many."""
    r = np.random.default_rng(11)
    centres = r.normal(size=(60, 32))
    rows = [(i, (centres[i % 60] + 0.06 * r.normal(size=32)).astype(np.float32).tolist(), int(r.integers(3))) for i in range(900)]
    rows += [(900 + i, rows[i][1], rows[i][2]) for i in range(50)] + [(990, None, 1), (991, [0.0] * 32, 1), (992, rows[0][1], None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    expected = con.execute(queries.ORACLE_SQL["op5_vector_dedup"]).df().sort_values("vec_id")
    got = queries.op5_vector_dedup(spark, str(tmp_path)).toPandas().sort_values("vec_id")[list(expected.columns)]
    assert expected["n_links"].sum() > 1000 and list(map(tuple, got.to_numpy())) == list(map(tuple, expected.to_numpy()))
