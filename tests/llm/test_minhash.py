import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ticklane.llm import components, minhash, queries

from .helpers import HARD, documents, stored


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_sets(texts, width=4):
    out = []
    for t in texts:
        w = words(t)
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def brute(texts, width=4):
    sets = brute_sets(texts, width)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def corpus():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = r.choices(vocabulary, k=60)
    texts = []
    for _ in range(60):
        base = r.choices(vocabulary, k=r.randint(60, 200))
        texts.append(" ".join(base))
        if r.random() < 0.5:
            for _ in range(r.randint(1, 6)):
                copy = list(base)
                for _ in range(r.randint(0, 5)):
                    copy[r.randrange(len(copy))] = r.choice(vocabulary)
                texts.append(" ".join(copy))
    texts += [" ".join(passage + r.choices(vocabulary, k=25)) for _ in range(60)]
    base = r.choices(vocabulary, k=150)
    for _ in range(120):  # a chain: each differs a little from the last
        base = list(base)
        base[r.randrange(150)] = r.choice(vocabulary)
        texts.append(" ".join(base).upper() if r.random() < 0.3 else " ".join(base))
    r.shuffle(texts)
    return [*texts, *HARD, *HARD, *texts[:40]]


def test_components_equal_brute_force(spark, tmp_path):
    texts = corpus()
    sizes, component = brute(texts)
    rows = {r.doc_id: r for r in queries.op9_minhash(spark, stored(tmp_path, documents=documents(spark, texts))).collect()}
    assert len(rows) == len(texts)
    assert [rows[i].n_shingles for i in range(len(texts))] == sizes
    right = sum(rows[i].component_id == component[i] for i in range(len(texts)))
    assert right >= 0.99 * len(texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows.values())


@pytest.mark.parametrize("rounds", [1, 3])
def test_pairs_left_for_small_blocks(spark, rounds):
    """One minhash to a band makes many candidates, and blocks of 16 documents many groups."""
    texts = corpus()
    sizes, component = brute(texts)
    few = minhash.Settings(width=4, bands=6, rows=1, block=16, agree=0.4, rounds=rounds)
    rows = {r.doc_id: r for r in minhash.near_duplicates(documents(spark, texts).select("doc_id", "text"), few).collect()}
    assert sum(rows[i].component_id == component[i] for i in range(len(texts))) >= 0.97 * len(texts)


def test_common_sizes_equal_set_intersections():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 300, r.integers(1, 200)).astype(np.uint64)) for _ in range(30)]
    i, j = np.arange(12), np.arange(5, 30)
    expected = [[len(np.intersect1d(sets[a], sets[b])) for b in j] for a in i]
    assert minhash.common_sizes(sets, i, j, columns=64).tolist() == expected
    assert minhash.common_sizes(sets[:1], np.array([0]), np.array([0])).tolist() == [[0]]  # no shingle of several sets


def test_null_ids_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "A B c d  e"), (3, None)], "doc_id long, text string")
    rows = [tuple(r) for r in minhash.near_duplicates(docs, minhash.Settings(width=4)).collect()]
    assert sorted(map(str, rows)) == sorted(map(str, [(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (2, 2, 1, False), (3, 0, 3, True)]))
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_paths_stars_and_rings(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(50, x) for x in range(200, 260)] + [(7, 9), (9, 8), (8, 7), (3, 3)]
    edges = [e if r.random() < 0.5 else e[::-1] for e in edges]
    found = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    expected = {**{i: 100 for i in range(101, 141)}, **{x: 50 for x in range(200, 260)}, 9: 7, 8: 7}
    assert found == expected


def test_minhash_estimates_similarity():
    a, b = np.arange(1, 1001, dtype=np.uint64), np.arange(201, 1201, dtype=np.uint64)
    factors = np.random.default_rng(1).integers(0, 1 << 63, 2000, np.uint64) * np.uint64(2) + np.uint64(1)
    same = (minhash.minhashes(minhash.mixed(a), factors) == minhash.minhashes(minhash.mixed(b), factors)).mean()
    assert same == pytest.approx(800 / 1200, abs=0.06)


def test_a_pair_of_equal_bytes_in_an_earlier_band_is_still_a_candidate():
    """The bytes of all minhashes are equal, but the first bands of both collections differ: the pair first meets by band 1 of the first."""
    s = minhash.Settings()
    one, other = np.arange(s.bands), np.arange(s.bands)
    other[0] += 1000
    group = {"own": [0, 0], "x": [0, 0], "y": [0, 0], "component": [1, 2], "n_shingles": [100, 100], "parts": [bytes(s.hashes)] * 2, "u": [one, other], "v": [one, other]}
    found = {at: minhash.candidates(pa.RecordBatch.from_pydict({**group, "band": [at, at]}), s)[2].tolist() for at in (1, 2)}
    assert found == {1: [[False, True], [False, False]], 2: [[False, False], [False, False]]}
    unmet = pa.RecordBatch.from_pydict({**group, "band": [1, 1], "v": [one, one + 1000]})
    assert not minhash.candidates(unmet, s)[2].any()  # no table key without a band of the second collection


def test_two_texts_under_one_id_and_clashing_columns(spark):
    rows = [(1, "a b c d e f g", "x", 7), (1, "h i j k l m n", "x", 7), (2, "A B c d  e f g", None, 7), (3, "h i j k l m n", None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, component long")
    found = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert found == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]
