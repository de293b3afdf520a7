import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from ticklane.llm import bloom_lm, queries

from .helpers import HARD, documents, stored


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [""]


def corpus(n=150):
    r = random.Random(9)
    chain = {i: [r.randrange(40) for _ in range(3)] for i in range(40)}

    def text():
        at, out = r.randrange(40), []
        for _ in range(r.randint(5, 80)):
            out.append(f"Wort{at}" if r.random() < 0.9 else f"rare{r.randrange(10**6)}")
            at = r.choice(chain[at])
        return " ".join(out)

    return [text() for _ in range(n)]


def expected(texts):
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    counts = Counter(w for t, h in zip(texts, held) if not h for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    rows = []
    for t in texts:
        words = tokens(t)
        rows.append((len(words), sum(counts[w] > 0 for w in words), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)))
    return held, rows


@pytest.mark.parametrize("hot", [131_072, 7])
def test_base_columns_equal_brute_force(spark, hot):
    texts = [*corpus(), *HARD, *HARD]
    held, rows = expected(texts)
    out = {r.doc_id: r for r in bloom_lm.score(documents(spark, texts), bloom_lm.Settings(hot=hot)).collect()}
    assert len(out) == len(texts)
    for i, (n, known, train, base) in enumerate(rows):
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9) and math.isfinite(r.score)


def test_pairs_beat_single_words_and_nonsense_on_held_out_texts(spark, tmp_path):
    r = random.Random(1)
    texts = corpus(400)
    shuffled = [" ".join(r.sample(t.split(), len(t.split()))) for t in texts]
    rows = {x.doc_id: x for x in queries.op6_bloom_lm(spark, stored(tmp_path, documents=documents(spark, texts))).collect()}
    held = [i for i in rows if rows[i].held_out]
    assert sum(rows[i].score for i in held) > sum(rows[i].base_score for i in held)
    both = texts + [shuffled[i] for i in held]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(i, shuffled[i]) for i in held], "doc_id long, text string")
    found = {}
    for x in bloom_lm.score(docs).collect():
        found.setdefault(x.doc_id, []).append(x.score)
    assert len(both) == len(texts) + len(held) and np.mean([max(found[i]) == pytest.approx(rows[i].score) for i in held]) > 0.9


def test_filter_levels(spark):
    s = bloom_lm.Settings()
    singles = spark.createDataFrame([(f"t{i}".encode(), 1 << (i % 12)) for i in range(3000)], "token binary, n long")
    pairs = spark.createDataFrame([(i * 7919, 5) for i in range(1, 2000)], "gram long, n long")
    f = bloom_lm.build_filter(singles, pairs, s)
    grams = np.array([bloom_lm.xxhash.xxh3_64_intdigest(f"t{i}".encode()) for i in range(3000)], np.uint64)
    level = f.levels(grams)
    assert (level >= np.arange(3000) % 12 + 1).all() and (level == np.arange(3000) % 12 + 1).mean() > 0.97
    assert (f.levels(np.arange(1, 2000, dtype=np.uint64) * np.uint64(7919)) >= 3).all()
    assert (f.levels(bloom_lm.mixed(np.arange(10**6, 10**6 + 5000, dtype=np.uint64))) == 0).mean() > 0.97


def test_filter_is_bounded(spark):
    s = bloom_lm.Settings(max_bits=1 << 18, segment_bits=16)
    singles = spark.createDataFrame([(f"t{i}".encode(), 1 + i % 9) for i in range(12_000)], "token binary, n long")
    f = bloom_lm.build_filter(singles, spark.createDataFrame([], "gram long, n long"), s)
    assert f.bits.size * 8 <= s.max_bits
    assert f.levels(np.array([bloom_lm.xxhash.xxh3_64_intdigest(b"t8")], np.uint64))[0] >= 4


def test_without_training_documents(spark):
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    docs = spark.createDataFrame([(held, "a b")], "doc_id long, text string")
    row = bloom_lm.score(docs).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0)
    assert bloom_lm.score(docs.limit(0)).count() == 0


def rare_pairs(n=700):
    """Documents of words of their own."""
    r = random.Random(4)
    return [" ".join(f"x{k}y{r.randrange(10**6)}" for _ in range(12)) for k in range(n)]


@pytest.mark.parametrize("max_bits", [1 << 28, 1 << 12])
def test_pairs_of_rare_words_are_learned(spark, max_bits):
    texts = rare_pairs()
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 10 == 0]
    taught = max(i for i in range(len(texts)) if i not in held)  # the last words of their frequency
    words = texts[taught].split()
    # Two held-out documents of one training document's words: as they stood there, and turned round.
    texts[held[0]], texts[held[1]] = " ".join(words), " ".join(words[::-1])
    rows = {r.doc_id: r for r in bloom_lm.score(documents(spark, texts), bloom_lm.Settings(max_bits=max_bits, unit=50, bucket_tokens=1000)).collect()}
    assert rows[held[0]].base_score == pytest.approx(rows[held[1]].base_score)
    assert rows[held[0]].score > rows[held[1]].score + 11 * 2


def test_buckets_score_as_the_broadcast_filter(spark):
    texts = [*corpus(300), *rare_pairs(100), *HARD, *HARD]
    one, other = ({r.doc_id: r for r in bloom_lm.score(documents(spark, texts), bloom_lm.Settings(max_bits=m, unit=40, bucket_tokens=500)).collect()} for m in (1 << 28, 1))
    assert len(one) == len(other) == len(texts)
    for i in one:
        assert one[i][:5] == other[i][:5] and one[i].base_score == pytest.approx(other[i].base_score) and one[i].score == pytest.approx(other[i].score)


def test_both_ways_score_alike_at_the_defaults(spark):
    texts = [*corpus(300), *rare_pairs(400)]
    one, other = (sorted(map(tuple, bloom_lm.score(documents(spark, texts), s).select("doc_id", "n_known", "score").collect())) for s in (bloom_lm.Settings(), bloom_lm.Settings(max_bits=1)))
    assert [x[:2] for x in one] == [x[:2] for x in other] and [x[2] for x in one] == pytest.approx([x[2] for x in other], rel=1e-12)


def test_the_filter_of_all_buckets_is_the_whole_filter(spark):
    s = bloom_lm.Settings(segment_bits=10)
    tokens = [(f"t{i}".encode(), 1 + i % 9) for i in range(3000)]
    whole = bloom_lm.build_filter(spark.createDataFrame(tokens, "token binary, n long"), spark.createDataFrame([], "gram long, n long"), s, 6000)
    grams = bloom_lm.placed(np.array([bloom_lm.xxhash.xxh3_64_intdigest(t) for t, _ in tokens], np.uint64))
    level = np.frexp([n for _, n in tokens])[1].astype(np.int64)
    for bucket in range(8):
        own = grams & np.uint64(7) == bucket
        part = bloom_lm.local_filter(grams[own], level[own], len(whole.bits), 8, s)
        assert np.array_equal(part.bits, whole.bits[bucket::8])


def test_filter_leaves_no_level_out(spark):
    s = bloom_lm.Settings(max_bits=1 << 18, segment_bits=16)
    singles = spark.createDataFrame([(f"t{i}".encode(), 1) for i in range(40_000)], "token binary, n long")
    f = bloom_lm.build_filter(singles, spark.createDataFrame([], "gram long, n long"), s)
    assert (f.levels(np.array([bloom_lm.xxhash.xxh3_64_intdigest(f"t{i}".encode()) for i in range(40_000)], np.uint64)) > 0).all()


def test_clashing_columns_and_repeated_rows(spark):
    docs = documents(spark, ["a b c", "a b c", "d e", None]).selectExpr("doc_id", "text", "'x' as SCORE", "1 as held_out", "2 as row", "3 as token")
    both = docs.union(docs)
    rows = sorted((r.doc_id, r.held_out, r.n_tokens, r.score) for r in bloom_lm.score(both).collect())
    assert len(rows) == 8 and rows[::2] == rows[1::2] and [r[2] for r in rows[::2]] == [4, 4, 3, 1]


def test_a_buckets_filter_is_built_and_probed_in_little_memory():
    s, r = bloom_lm.Settings(), np.random.default_rng(4)
    grams = np.unique(r.integers(0, 1 << 63, 400_000).astype(np.uint64))
    level = np.minimum(r.geometric(0.6, len(grams)), 20)
    tracemalloc.start()
    part = bloom_lm.local_filter(grams, level, 32, 1, s)
    found = part.found(np.concatenate([grams, grams + np.uint64(1)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50_000_000
    assert (found[: len(grams)] >= level).all() and (found[len(grams) :] == 0).mean() > 0.9
