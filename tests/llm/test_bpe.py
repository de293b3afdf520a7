import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ticklane.llm import bpe, queries
from ticklane.llm.common import vocabulary_path

from .helpers import HARD, documents, stored


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(vocabulary_path(queries.WORD_BPE))
    t.no_padding()
    t.no_truncation()
    return t


@pytest.fixture(scope="module")
def codec():
    return bpe.BpeCodec(vocabulary_path(queries.WORD_BPE))


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x24F, exclude_categories=["Cs"]), st.sampled_from("aeth'sSΣςé中の🎉 \n<|>")), max_size=60))
def test_encodes_like_the_library(library, codec, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert codec.encode(text) == ids
    assert " ".join(codec.strings[i] for i in ids) == library.decode(ids, skip_special_tokens=False)


def test_query_on_hard_texts(spark, tmp_path, library):
    texts = [*HARD, *HARD]
    rows = {r.doc_id: r for r in queries.op3_bpe(spark, stored(tmp_path, documents=documents(spark, texts))).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (rows[i].n_tokens, rows[i].ids_sha256) == (len(ids), sha(" ".join(map(str, ids)))), t
        assert rows[i].decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_empty_table_and_clashing_columns(spark):
    docs = documents(spark, ["Hello"]).selectExpr("*", "'x' as TOKEN_IDS")
    out = bpe.encode(docs, queries.WORD_BPE)
    assert [c.lower() for c in out.columns].count("token_ids") == 1 and out.first()["token_ids"] == [3306]
    assert bpe.decode(bpe.encode(docs.limit(0), queries.WORD_BPE), queries.WORD_BPE).count() == 0


def test_cache_is_bounded():
    small = bpe.RecentCache(lambda words: [w * 2 for w in words], limit=3)
    for words in ("ab", "cc", "defg", "ab", "a", "", "gabz"):
        assert small.many(list(words)) == [w * 2 for w in words] and len(small) <= 3 and len(small.old) <= 3
