import numpy as np
import pytest

from ticklane.llm import queries, vector_dedup

from .helpers import stored

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    good = []
    for i, (_, v, label) in enumerate(rows):
        if v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.append(i)
    unit = {i: vector_dedup.units(np.array([rows[i][1]], np.float32).astype(float))[0] for i in good}
    links = {i: set() for i in range(len(rows))}
    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98:
                links[a].add(b)
                links[b].add(a)
    component = {}
    for i in range(len(rows)):
        if i not in component:
            todo, seen = [i], {i}
            while todo:
                for j in links[todo.pop()] - seen:
                    seen.add(j)
                    todo.append(j)
            low = min(rows[j][0] for j in seen)
            component.update(dict.fromkeys(seen, low))
    return {rows[i][0]: (len(links[i]), component[i]) for i in range(len(rows))}


def corpus():
    r = np.random.default_rng(4)
    rows = []
    for _ in range(500):
        rows.append((r.normal(size=16) * r.choice([1e-30, 1, 1e30]), int(r.integers(3))))
    for _ in range(40):
        v, label = r.normal(size=16), int(r.integers(3))
        rows += [(v + r.normal(size=16) * r.choice([0.0, 0.03, 0.06, 0.1]), int(r.choice([label, label, label, 0]))) for _ in range(6)]
    v = r.normal(size=16)
    for _ in range(60):
        v = v + r.normal(size=16) * 0.03
        rows.append((v, 1))
    rows += [(np.ones(16) * (k + 1), 2) for k in range(30)] + [(np.ones(5), 2)] * 3 + [(r.normal(size=40), 0)] * 2 + [(np.zeros(16), 1)] * 2
    order = r.permutation(len(rows))
    out = [(i, [float(x) for x in rows[k][0].astype(np.float32)], rows[k][1]) for i, k in enumerate(order)]
    n = len(out)
    return out + [(n, None, 1), (n + 1, [], 1), (n + 2, [1.0, None], 1), (n + 3, [float("nan")] * 16, 1), (n + 4, [float("inf")] * 16, 1), (n + 5, [1.0] * 16, None), (n + 6, [1.0] * 16, None)]


def check(got, rows):
    expected = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id) == expected[r.vec_id], r
        assert r.kept == (r.vec_id == r.component_id)


def test_links_equal_brute_force(spark, tmp_path):
    rows = corpus()
    check(queries.op5_vector_dedup(spark, stored(tmp_path, embeddings=spark.createDataFrame(rows, SCHEMA))).collect(), rows)


def test_small_blocks_and_a_tiny_sample_lose_nothing(spark):
    rows = corpus()
    s = vector_dedup.Settings(least_lists=5, per_list=8, subspaces=3, codes=8, sample=40, block=16, queries=48)
    check(vector_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), s).collect(), rows)


def test_repeated_rows_null_ids_empty_and_clash(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (None, [1.0, 2.0], 0), (2, [2.0, 4.0], 0)], SCHEMA).selectExpr("*", "'x' as KEPT")
    rows = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_duplicates(df).collect()), key=str)
    assert rows == [(0, 0, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0


def test_recall_in_64_dimensions(spark):
    """Pairs just inside the link distance, in as many lists as 4,000 vectors have."""
    r = np.random.default_rng(6)
    x = r.normal(size=(2000, 64)) + 2 * r.normal(size=(40, 64))[r.integers(40, size=2000)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = r.normal(size=x.shape)
    y -= (x * y).sum(1, keepdims=True) * x
    y = x + 0.195 * y / np.linalg.norm(y, axis=1, keepdims=True)
    both = np.concatenate([x, y]).astype(np.float32)
    unit = vector_dedup.units(both.astype(float))
    expected = (unit @ unit.T >= 0.98).sum(1) - 1
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(both)], SCHEMA)
    found = {r.vec_id: r.n_links for r in vector_dedup.near_duplicates(rows).collect()}
    got = np.array([found[i] for i in range(len(both))])
    assert expected.sum() >= 3900 and (got <= expected).all() and got.sum() >= 0.999 * expected.sum()


@pytest.mark.parametrize("n, width, spread", [(4000, 64, 8), (3000, 384, 16), (3000, 384, 384)])
def test_recall_on_vectors_of_uneven_spread(spark, n, width, spread):
    """Pairs at distance 0.19, the spread carried by a few dimensions: links of the whole operator against brute force."""
    r = np.random.default_rng(spread)
    scale = np.where(np.arange(width) < spread, 1.0, 0.02)
    base = vector_dedup.units(r.normal(size=(n // 2, width)) * scale)
    step = r.normal(size=base.shape) * scale
    x = np.concatenate([base, base + 0.19 * step / np.linalg.norm(step, axis=1, keepdims=True)]).astype(np.float32)
    exact = vector_dedup.units(x.astype(float))
    links = np.zeros(n, int)
    for at in range(0, n, 1000):
        links[at : at + 1000] = (exact[at : at + 1000] @ exact.T >= 0.98).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in vector_dedup.near_duplicates(df).select("vec_id", "n_links").collect()}
    found = np.array([got[i] for i in range(n)])
    assert links.sum() > n * 0.9 and (found <= links).all() and found.sum() >= 0.99 * links.sum()
