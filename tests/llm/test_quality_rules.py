import re

from ticklane.llm import quality_rules, queries, textstats

from .helpers import HARD, documents, stored

PROSE = "The committee agreed that further measurements would be needed before any conclusion about the river could be drawn. Several residents said they had noticed the change years ago, while others remembered nothing unusual. " * 1 + "A report is expected in spring, and the council has promised to publish it in full together with the underlying figures and the letters it received."
TEXTS = [
    *HARD,
    PROSE,
    " ".join("qzxjkvwpy"[i % 7 :] + str(i * 7919) for i in range(60)),
    "a b c d a b c x a b c " * 7,
    "same line\n\nsame line\n \nother\nsame line \nother\n" + "#$%&|<>*!",
    "q w e q w e q w",
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = {}
    for w in windows:
        many[w] = many.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if many[w] >= 2 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_counts_and_verdicts(spark, tmp_path):
    rows = {r.doc_id: r for r in queries.op1_quality_rules(spark, stored(tmp_path, documents=documents(spark, [*TEXTS, *TEXTS]))).collect()}
    assert len(rows) == 2 * len(TEXTS)
    for i, t in enumerate([*TEXTS, *TEXTS]):
        r, expected = rows[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected, t
        assert r.base_failed == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])
        assert not (r.base_failed and r.kept)
    at = TEXTS.index(PROSE)
    assert rows[at].kept and not rows[at + 1].base_failed and not rows[at + 1].kept


def test_fertility_matches_the_libraries():
    f = quality_rules.Fertility(quality_rules.PIECES, quality_rules.BYTES)
    words = [w.encode() for w in "naïve 中文 plain plain 🎉".split()]
    distinct, ids = textstats.numbered(words)
    out = f.measures(distinct, __import__("numpy").bincount(ids), 18)
    pieces = [i for w in words for i in f.pieces.encode(w.decode())]
    ranks = [i for w in words for i in f.bytes.encode_ordinary(" " + w.decode())]
    assert out[0] == 18 / len(pieces) and out[3] == 18 / len(ranks)
    assert abs(out[1] - sum(map(f.pieces.is_byte, pieces)) / len(pieces)) < 1e-12 and 0 < out[4] < 1 and 0 < out[2] <= 1
    assert f.measures([], textstats.np.zeros(0, int), 0) == [None] * 6


def test_scripts():
    assert [quality_rules.script_of(t) for t in ("abc é", "привет мир", "中文字符", "αβγ", "123 !", "مرحبا", "नमस्ते")] == ["latin", "cyrillic", "cjk", "greek", "other", "semitic", "indic"]


def test_unknown_language_uses_the_script_and_clashes_are_replaced(spark):
    docs = documents(spark, [PROSE]).selectExpr("doc_id", "text", "cast(null as string) lang", "'x' as N_WORDS")
    row = quality_rules.judge(quality_rules.measure(docs)).first()
    assert row["kept"] and row["script"] == "latin" and row["n_words"] == len(PROSE.split())
    assert quality_rules.judge(quality_rules.measure(docs.limit(0))).count() == 0


def test_many_distinct_words_take_the_wide_codes():
    import numpy as np

    ids = np.concatenate([np.arange(2**21 + 5), np.arange(4)])
    assert textstats.repeated_words(ids) == 8


def test_bands_keep_documents_labelled_good_and_reject_most_others(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op1_quality_rules(spark, sf).where("not base_failed").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id").collect()
    good, bad = ([r.kept for r in rows if r.quality == k] for k in (1, 0))
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.6 * len(bad)


def test_texts_without_letters_and_either_vocabulary_can_reject(spark):
    rows = quality_rules.measure(documents(spark, ["12 34 56", "a 12"])).orderBy("doc_id").collect()
    assert [r["script"] for r in rows] == ["other", "latin"]
    measured = quality_rules.measure(documents(spark, [PROSE])).drop("text")
    for name, value in (("pieces_fallback_share", 0.5), ("bytes_fallback_share", 0.5), ("pieces_entropy", 0.1), ("bytes_entropy", 0.1), ("bytes_chars_per_token", 1.0), ("pieces_chars_per_token", 1.0)):
        assert not quality_rules.judge(measured.selectExpr(*[c for c in measured.columns if c != name], f"{value}D as {name}")).first()["kept"], name
