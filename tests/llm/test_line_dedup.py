import hashlib
import random

from pyspark.sql import functions as F

from ticklane.llm import line_dedup, queries
from ticklane.llm.line_dedup import Settings

from .helpers import HARD, SCHEMA, documents, stored

UPPER = {x: x + 32 for x in range(65, 91)}


def brute(rows, min_chars=20, min_docs=3):
    """rows of (doc_id, text) -> sorted (doc_id, n_lines, n_dropped, kept text)."""
    key = lambda line: line.strip(" \t\n\v\f\r").translate(UPPER)
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held.get(key(x), ())) < min_docs or i == max(held[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def got(df, **settings):
    rows = line_dedup.drop_repeated(df, Settings(**settings)).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    return sorted(map(tuple, rows), key=repr)


def corpus(seed=5, n=400):
    r = random.Random(seed)
    pool = [f"  Shared line number {i} {'ü' * (i % 9)}" for i in range(60)] + ["short", "", "é" * 19, "é" * 20, " " * 30]
    hot = "This line stands in nearly every document."
    return [(i, "\n".join(r.choice([hot, hot.upper(), f"only document {i} line {j} holds this", r.choice(pool)]) for j in range(r.randrange(12)))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)


def test_equals_brute_force_for_any_run_and_partitioning(spark):
    rows = corpus()
    expected = brute(rows)
    assert sum(x[2] for x in expected) > 300
    for run_rows, parts in ((500_000, 3), (1, 7), (40, 2)):
        assert got(frame(spark, rows).repartition(parts), run_rows=run_rows) == expected


def test_batches_of_one_row_carry_a_key_along(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        rows = corpus(9, 60)
        assert got(frame(spark, rows).repartition(4), run_rows=1) == brute(rows)
        assert got(frame(spark, rows).repartition(4), run_rows=1, min_docs=5, min_chars=5) == brute(rows, 5, 5)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_hard_texts_repeated_rows_and_missing_ids(spark):
    line = "a line of more than twenty letters"
    rows = [*enumerate(HARD), (50, line), (51, line), (51, line), (51, line + "\n" + line + "\nx"), (None, line), (None, None)]
    assert got(frame(spark, rows)) == brute(rows)
    rows += [(52, "y\n" + line + "\r")]
    assert got(frame(spark, rows)) == brute(rows) and ("y\n" + line + "\r") in [x[3] for x in got(frame(spark, rows))]
    assert got(frame(spark, rows).union(frame(spark, rows))) == brute(rows + rows)


def test_one_very_long_text(spark):
    text = "\n".join(f"line {i % 700} of the very long text here" for i in range(60_000))
    rows = [(1, text), (2, text), (3, "line 5 of the very long text here"), (4, text[:100])]
    assert got(frame(spark, rows), run_rows=1000) == brute(rows)


def test_bitmaps_name_only_texts_that_lose_lines(spark):
    rows = [(i, f"first of {i}\nthis line is in all the documents\nlast") for i in range(4)]
    marks = line_dedup.keep_bitmaps(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped) for r in marks) == [(i, 3, 1) for i in range(3)]
    assert all(line_dedup.unpacked(r.keep, 3).tolist() == [1, 0, 1] for r in marks)


def test_a_hot_line_sends_few_rows_to_its_range(spark):
    rows = [(i, "this line is in all the documents") for i in range(3000)]
    lines = line_dedup.line_rows(frame(spark, rows).coalesce(2), Settings(), "doc_id", "text")
    open_rows = lines.where(F.col("mark") != line_dedup.FALLS)
    assert lines.count() == 3000 and open_rows.count() <= 2 and lines.select("h1").distinct().count() > 2900


def test_empty_table_and_clashing_columns(spark):
    assert line_dedup.drop_repeated(documents(spark, ["a"]).limit(0)).count() == 0
    docs = documents(spark, ["one line that all of them hold"] * 4).selectExpr("*", "'x' as N_LINES", "7 as version", "'k' as keep", "1 as position", "2 as id")
    rows = line_dedup.drop_repeated(docs).collect()
    assert sorted((r["n_dropped"], r["keep"], r["version"]) for r in rows) == [(0, "k", 7)] + [(1, "k", 7)] * 3


def test_query_digest(spark, tmp_path):
    rows = corpus(3, 50)
    out = queries.op12_line_dedup(spark, stored(tmp_path, documents=frame(spark, rows))).collect()
    assert sorted(map(tuple, out)) == sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(rows))
