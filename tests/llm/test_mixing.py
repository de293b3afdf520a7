import random
import re

import pytest

from ticklane.llm import mixing, queries

from .helpers import HARD, documents, stored


def water(sizes):
    """Targets by sharing and resharing until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, full, left = {}, set(), float(sum(sizes.values()))
    while True:
        open_ = [s for s in order if s not in full]
        rest = left - sum(3 * sizes[s] for s in full)
        target = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in open_) for s in order}
        over = {s for s in open_ if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


def corpus(spark, n=600):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 20, 60])), "en", r.choice(["hot"] * 8 + ["b", "é", "𝄞", None, "tiny" if i < 30 else "b"]), 0) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def check(rows, docs):
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs}
    sums = {}
    for r in docs:
        sums[r.source] = sums.get(r.source, 0) + size[r.doc_id]
    targets, taken, largest = water(sums), dict.fromkeys(sums, 0), dict.fromkeys(sums, 0)
    source = {r.doc_id: r.source for r in docs}
    for r in rows:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == sums[s] and r.target == pytest.approx(targets[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in sums:
        assert abs(taken[s] - targets[s]) <= largest[s] / 2 + 1e-6, s


def test_takes_come_near_targets_and_reruns_agree(spark, tmp_path):
    docs = corpus(spark)
    sf = stored(tmp_path, documents=docs)
    rows = queries.op8_mixing(spark, sf).collect()
    assert len(rows) == 600
    check(rows, docs.collect())
    again = queries.op8_mixing(spark, sf).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    whole = mixing.mix(docs).select("doc_id", "taken", "copies", "text").collect()
    assert sorted(map(key, whole)) == sorted(map(key, rows))


def test_hard_texts_one_source_and_repeated_rows(spark, tmp_path):
    docs = documents(spark, HARD)
    rows = queries.op8_mixing(spark, stored(tmp_path, documents=docs)).collect()
    check(rows, docs.collect())
    one = documents(spark, ["a b c"]).withColumns({"source": mixing.F.lit("s"), "TAKEN": mixing.F.lit(1)})
    out = mixing.mix(one.union(one)).collect()
    assert [(r["taken"], r["copies"]) for r in out] == [(3, 1), (3, 1)] and out[0]["target"] == 6.0


def test_empty(spark):
    assert mixing.mix(documents(spark, ["a"]).limit(0)).count() == 0
    assert [r["taken"] for r in mixing.mix(documents(spark, ["", None])).collect()] == [0, 0]


def test_clashing_columns(spark):
    docs = documents(spark, ["a b", "c", None]).selectExpr("*", "'x' as SIZE", "'y' as Taken", "7 as copies")
    rows = mixing.mix(docs).collect()
    assert sorted(r["size"] for r in rows) == [0, 1, 2] and all(isinstance(r["copies"], int) and r["copies"] <= 3 for r in rows)
