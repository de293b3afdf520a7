import random
import zlib

import numpy as np

from ticklane.llm import boosted_trees, queries

from .helpers import HARD, documents, stored


def corpus(n):
    words = ["river", "stone", "morning", "letter", "council", "figure", "garden", "engine", "window", "paper", "later", "found"]
    r = random.Random(1)
    good = lambda: ". ".join(" ".join(r.choices(words, k=9)).capitalize() for _ in range(r.randint(3, 30))) + "."
    bad = lambda: " ".join(f"{w.upper()}!!" for w in r.choices(words, k=200)) if r.random() < 0.5 else " ".join([r.choice(words)] * 150)
    labels = [int(r.random() < 0.7) for _ in range(n)]
    return [good() if y else bad() for y in labels], labels


def test_held_out_accuracy_and_hard_texts(spark, tmp_path):
    texts, labels = corpus(400)
    docs = documents(spark, [*texts, *HARD])
    marks = spark.createDataFrame([(i, y, 0) for i, y in enumerate(labels)] + [(0, labels[0], 1), (5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    sf = stored(tmp_path, documents=docs, labels=marks)
    rows = {r.doc_id: r for r in queries.op10_quality_classifier(spark, sf).collect()}
    assert len(rows) == 400 + len(HARD)
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [i for i in range(400) if rows[i].held_out]
    assert np.mean([rows[i].predicted == labels[i] for i in held]) > 0.95
    again = {r.doc_id: r.score for r in queries.op10_quality_classifier(spark, sf).collect()}
    assert again == {i: r.score for i, r in rows.items()}


def test_held_out_labels_are_not_learned(spark):
    texts, labels = corpus(120)
    docs = documents(spark, texts)
    rows = [(i, y) for i, y in enumerate(labels)]
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in rows]
    a, b = (boosted_trees.fit(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (rows, flipped))
    assert np.array_equal(a.threshold, b.threshold) and np.array_equal(a.leaf, b.leaf)


def test_without_labels_the_score_is_constant(spark):
    docs = documents(spark, HARD).selectExpr("*", "'x' as Score")
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in boosted_trees.score(docs, boosted_trees.fit(docs, empty)).collect()} == {0.5}
    assert boosted_trees.score(docs.limit(0), boosted_trees.fit_trees(np.zeros((0, 22)), np.zeros(0))).count() == 0


def test_flattened_walk_equals_a_walk_node_by_node():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5))
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float)
    t = boosted_trees.fit_trees(x, y, trees=20, depth=3)
    for row, got in zip(x[:20], t.score(x[:20])):
        total = t.base
        for f, cut, leaf in zip(t.feature, t.threshold, t.leaf):
            node = 0
            while node < 7:
                node = 2 * node + 1 + (row[f[node]] > cut[node])
            total += leaf[node - 7]
        assert abs(got - 1 / (1 + np.exp(-total))) < 1e-12
    assert ((t.score(x) > 0.5) == y).mean() > 0.9


def test_repeated_rows_and_two_texts_under_one_id_score_alike_on_reruns(spark):
    texts, labels = corpus(60)
    docs = documents(spark, texts)
    twice = docs.union(docs).union(documents(spark, texts[::-1]).limit(20))
    marks = spark.createDataFrame([(i, y, 0) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int")
    one, other = (boosted_trees.fit(d, marks) for d in (twice.coalesce(1), twice.repartition(5)))
    assert np.array_equal(one.threshold, other.threshold) and np.array_equal(one.leaf, other.leaf)
    scored = boosted_trees.score(docs.union(docs), one).groupBy("doc_id").agg({"score": "min", "*": "count"}).collect()
    assert all(r["count(1)"] == 2 for r in scored)
