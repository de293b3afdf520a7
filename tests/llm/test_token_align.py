import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ticklane.llm import queries, token_align
from ticklane.llm.token_align import Settings

from .helpers import HARD, documents, stored

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def pieces(sides, text):
    """The tokens of both sides as (id, start, end), or none."""
    if not text:
        return [], []
    a, b = sides
    letters = token_align.byte_letters()
    out = []
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    bytes_a = [bytes(letters.index(x) for x in a.id_to_token(i)) for i in ids_a]
    ids_b = b.encode(text, num_threads=1)
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    for ids, parts in ((ids_a, bytes_a), (ids_b, bytes_b)):
        if b"".join(parts) != (" " + text).encode():
            return [], []
        at, row = 0, []
        for i, x in zip(ids, parts):
            row.append((i, at, at + len(x)))
            at += len(x)
        out.append(row)
    return out


def brute(sides, rows):
    docs = [(i, *pieces(sides, t)) for i, t in rows]
    linked = [[(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] for _, a, b in docs]
    counts = Counter(p for links in linked for p in links)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for (i, a, b), links in zip(docs, linked):
        ends = sorted({x[2] for x in a} & {x[2] for x in b})
        groups = ";".join("|".join(",".join(str(x[0]) for x in side if start < x[2] <= end) for side in (a, b)) for start, end in zip([0, *ends], ends))
        out.append((i, len(a), len(b), len(ends), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "", groups))
    return sorted(out, key=repr)


def got(df, settings=Settings()):
    return sorted(map(tuple, token_align.align(df, settings).select(*COLUMNS).collect()), key=repr)


def corpus(n=90, seed=2):
    r = random.Random(seed)
    words = "the cat naïve façade Straße 12345 3.14 <|endoftext|> <s> </s> <unk> tokenisation unbelievable don't 中文 ことば 🎉 ▁   \n \t größer ".split(" ")
    return [" ".join(r.choice(words) for _ in range(r.randrange(1, 40))) for _ in range(n)]


def test_equals_brute_force_whatever_units_and_slots(spark, sides):
    texts = [x for x in HARD if len(x or "") < 1000] + corpus()
    df = documents(spark, texts).select("doc_id", "text")
    expected = [x[:-1] for x in brute(sides, enumerate(texts))]
    assert sum(x[1] > 0 for x in expected) > 40 and sum(x[5] for x in expected) < sum(x[4] for x in expected)
    for settings in (Settings(), Settings(unit_bytes=200, count_entries=50, task_links=30, stripe_ids=4000)):
        assert got(df.repartition(3), settings) == expected


def test_long_texts(spark, sides):
    texts = ["to be or not to be " * 800, "x" * 3000, "a line\n" * 900]
    expected = [x[:-1] for x in brute(sides, enumerate(texts))]
    assert got(documents(spark, texts)) == expected


def test_repeated_rows_missing_ids_clashing_columns_and_empty_tables(spark, sides):
    docs = documents(spark, ["one two", None]).selectExpr("*", "1 as N_A", "'x' as unit", "2 as data", "3 as facts")
    rows = docs.union(docs).union(docs.selectExpr("null as doc_id", *docs.columns[1:]))
    assert got(rows) == [x[:-1] for x in brute(sides, [(0, "one two"), (1, None)] * 2 + [(None, "one two"), (None, None)])]
    assert got(docs.limit(0)) == []
    assert got(documents(spark, [None, ""])) == [(0, 0, 0, 0, 0, 0, 0, ""), (1, 0, 0, 0, 0, 0, 0, "")]


def test_groups_and_best_pairs(spark, sides):
    texts = corpus(20, 7)
    rows = brute(sides, enumerate(texts))
    found = {r.doc_id: r.groups for r in token_align.with_groups(documents(spark, texts)).collect()}
    assert found == {r[0]: r[-1] for r in rows}
    counts = Counter()
    for t in texts:
        a, b = pieces(sides, t)
        counts.update((y[0], x[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2])
    best = Counter()
    for (b, _), n in counts.items():
        best[b] = max(best[b], n)
    pairs = {tuple(r) for r in token_align.best_pairs(documents(spark, texts)).collect()}
    assert pairs == {(b, a, n) for (b, a), n in counts.items() if n == best[b]}


def test_the_quick_encoder_equals_the_library_on_known_letters(sides):
    side = token_align.ByteSide(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(4)
    known = [chr(x) for x in range(0x2040) if not token_align.KNOWN.search(chr(x))] + ["€"]
    texts = [f"a{x}b {x} {x}{x}1{x}'s\n{x} " for x in known] + ["".join(r.choice(known) for _ in range(50)) for _ in range(2000)]
    assert side.quick and side.encode(texts) == [x.ids for x in sides[0].encode_batch([" " + x for x in texts], add_special_tokens=False)]


def test_query(spark, sides, tmp_path):
    texts = corpus(10, 1)
    out = queries.op13_token_align(spark, stored(tmp_path, documents=documents(spark, texts)))
    assert out.columns == COLUMNS and sorted(map(tuple, out.collect())) == [x[:-1] for x in brute(sides, enumerate(texts))]
