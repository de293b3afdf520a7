import random
import re
from collections import Counter

from ticklane.llm import queries, source_audit
from ticklane.llm.source_audit import Settings

from .helpers import HARD, SCHEMA, documents, stored

UPPER = {x: x + 32 for x in range(65, 91)}


def brute(rows, min_docs=3, top=200):
    """rows of (text, lang, source) -> rows of the audit, every term of every group priced."""
    rows = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(UPPER)), la or "", so or "") for t, la, so in rows]
    out = []
    for lang in {x[1] for x in rows}:
        of = [x for x in rows if x[1] == lang]
        docs = Counter(w for words, *_ in of for w in set(words))
        kept = [w for w in docs if docs[w] >= min_docs]
        share = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c[x] for x in kept) + len(kept)) for w in kept}
        counts = {s: Counter(w for words, _, so in of if so == s for w in words) for s in {x[2] for x in of}}
        p = {s: share(c) for s, c in counts.items()}
        whole = share(sum(counts.values(), Counter()))
        f = lambda x, y: (x - y) ** 2 // y
        ranked = lambda found: enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode())), 1)
        for s in p:
            out += [(lang, s, "pair", h, v, i) for i, (h, v) in ranked([(h, sum(f(p[s][w], p[h][w]) for w in kept)) for h in p if h != s])]
            out += [(lang, s, "term", w, v, i) for i, (w, v) in ranked([(w, f(p[s][w], whole[w])) for w in kept if counts[s][w] and p[s][w] > whole[w]]) if i <= top]
    return sorted(out)


def corpus(n=300, seed=6):
    r = random.Random(seed)
    words = [f"word{'abcdefghij'[i % 10] * (i // 10 + 1)}" for i in range(80)] + ["Über", "über", "ß中", "É", "é", "a-b", "x1y"]
    sources = ["hot"] * 8 + ["b", "é", "𝄞", None, "", "tiny", "z"]
    rows = []
    for i in range(n):
        s = r.choice(sources)
        own = words[: 20 + 7 * (sources.index(s) % 9)]
        rows.append((" ".join(r.choice(own) for _ in range(r.randrange(15))), r.choice(["en", "en", "de", None]), s))
    return rows + [("", "xx", "empty"), (None, "xx", "b"), ("only here", "yy", "one"), (None, "en", "silent")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, la, so, 0) for i, (t, la, so) in enumerate(rows)], SCHEMA)


def got(df, **settings):
    return sorted(map(tuple, source_audit.audit(df, Settings(**settings)).collect()))


def test_equals_brute_force_for_any_blocks_and_runs(spark):
    rows = corpus()
    expected = brute(rows)
    assert len({x[4] for x in expected}) > 100 and ("xx", "b", "pair", "empty", 0, 1) in expected
    for settings in ({}, {"block": 2, "held": 1, "few": 0}):
        assert got(frame(spark, rows).repartition(3), **settings) == expected
    assert got(frame(spark, rows), min_docs=8, top=5) == brute(rows, 8, 5)


def test_hard_texts_and_repeated_rows(spark):
    rows = [(x, None, None) for x in HARD] + [(x, None, "other") for x in HARD] + [("to be or not " * 20_000, "", "long")]
    assert got(frame(spark, rows)) == brute(rows)
    assert got(frame(spark, rows).union(frame(spark, rows))) == brute(rows + rows)


def test_shares_stay_exact_for_counts_beyond_64_bits_of_product(spark):
    n, total = 7 * 10**17 + 3, 9 * 10**17 + 1
    row = spark.sql(f"select {n}L as n, {total}L as total").select(source_audit.share(source_audit.F.col("n"), source_audit.F.col("total")).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 1) // total


def test_empty_table_and_clashing_columns(spark):
    assert got(documents(spark, ["a"]).limit(0)) == []
    rows = corpus(40)
    assert got(frame(spark, rows).selectExpr("*", "1 as term", "2 as n", "'x' as item", "3 as docs", "4 as i")) == brute(rows)


def test_query(spark, tmp_path):
    rows = corpus(60, 1)
    out = queries.op11_source_audit(spark, stored(tmp_path, documents=frame(spark, rows)))
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"] and sorted(map(tuple, out.collect())) == brute(rows)
