import random

import corpus_pipeline
from ticklane.llm import bpe, mixing, secrets
from ticklane.llm.common import vocabulary_path

from . import test_boosted_trees, test_minhash
from .helpers import HARD, documents, stored


def corpus(spark, tmp_path):
    good, labels = test_boosted_trees.corpus(200)
    r = random.Random(8)
    copies = [t for t in good[:20] if len(t) > 600] * 2
    copies += [t + " trailing words" for t in good[:10] if len(t) > 800]
    secret = [good[k] + " password=abcdefabcdef123456" for k in range(3) if labels[k]]
    texts = [*good, *copies, *secret]
    r.shuffle(texts)
    at = {t: y for t, y in zip(good, labels)}
    docs = documents(spark, texts)
    marks = spark.createDataFrame([(i, at[t], 0) for i, t in enumerate(texts) if t in at], "doc_id long, quality int, toxic int")
    return stored(tmp_path, documents=docs, labels=marks), texts, at


def test_every_stage_takes_effect(spark, tmp_path):
    sf, texts, labels = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        kept[name] = docs.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    ids = lambda name: {r.doc_id for r in kept[name]}
    first = ids("quality classifier")
    assert all((i in first) == bool(labels[t]) for i, t in enumerate(texts) if t in labels)
    by_id = sorted(first)
    component = test_minhash.brute([texts[i] for i in by_id], 5)[1]
    assert ids("minhash near-dedup") == {i for k, i in enumerate(by_id) if component[k] == k}
    assert ids("secret scan") == ids("minhash near-dedup")
    assert not any(secrets.find_spans(r.text) for r in kept["secret scan"])
    clean = [r for r in kept["secret scan"] if "[secret]" not in r.text]
    assert clean and all(r.text == texts[r.doc_id] for r in clean)
    often = {}
    for r in kept["source mix"]:
        often[r.doc_id] = often.get(r.doc_id, 0) + 1
    plan = {r.doc_id: r.copies for r in mixing.mix(spark.read.parquet(f"{tmp_path}/stage2")).collect()}
    assert often == {i: n for i, n in plan.items() if n}
    codec = bpe.BpeCodec(vocabulary_path("word_bpe_49k.json"))
    text = {r.doc_id: r.text for r in kept["source mix"]}
    assert all(list(r.token_ids) == codec.encode(text[r.doc_id]) and r.n_tokens == len(r.token_ids) for r in kept["bpe encoding"])
    whole = sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, sf).collect())
    assert whole == sorted((r.doc_id, r.n_tokens) for r in kept["bpe encoding"])


def test_rows_without_ids_stay_and_empty_tables_pass(spark, tmp_path):
    sf, _, _ = corpus(spark, tmp_path)
    docs = spark.createDataFrame([(None, "same text here now", None, None, None)] * 2 + [(4, "other", "en", "s", 5)] * 2, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.keep_one_of_each(spark, docs, sf).count() == 3
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_hard_texts_and_extra_columns_pass_through_all_stages(spark, tmp_path):
    sf, _, _ = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet").union(documents(spark, HARD).selectExpr("doc_id + 10000 as doc_id", "text", "lang", "source", "n_chars"))
    docs = docs.selectExpr("*", "1 as score", "'x' as spans", "2 as copies", "3 as component_id", "'y' as token_ids")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/hard{k}")
        docs = spark.read.parquet(f"{tmp_path}/hard{k}")
    assert docs.columns == ["doc_id", "source", "n_tokens", "token_ids"] and docs.count() > 0


def test_different_texts_under_one_id_stay(spark, tmp_path):
    sf, _, _ = corpus(spark, tmp_path)
    rows = [(1, "one text of six words here", "en", "b", 5), (1, "one text of six words here", "en", "a", 5), (1, "quite another text under that id", None, None, None), (2, "One text of six words HERE", "en", "s", 5)]
    kept = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), sf)
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [rows[1], rows[2]]))


def test_null_sources_and_texts_through_the_mix(spark):
    rows = [(i, t, "en", s, 3) for i, (t, s) in enumerate([("a b c", None), (None, None), ("", "x"), ("d e f g", "x"), (None, "only")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mix_sources(spark, docs, "").collect()
    plan = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    assert sorted(r.doc_id for r in mixed) == sorted(i for i, n in plan.items() for _ in range(n)) and {0, 3} <= {r.doc_id for r in mixed}
    assert {r.doc_id: (r.text, r.source) for r in mixed} == {i: (t, s) for i, t, _, s, _ in rows if plan[i]}


def test_good_documents_without_or_with_contradicting_labels(spark, tmp_path):
    docs = documents(spark, [*["some plain words of prose " * 9] * 4, None, ""])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = corpus_pipeline.keep_good(spark, docs, stored(tmp_path / "none", labels=none)).count()
    assert kept == docs.count()  # nothing is known against them
    both = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    once = sorted(r.doc_id for r in corpus_pipeline.keep_good(spark, docs, stored(tmp_path / "both", labels=both)).collect())
    assert once == sorted(r.doc_id for r in corpus_pipeline.keep_good(spark, docs.repartition(3), stored(tmp_path / "both", labels=both.repartition(2))).collect())
