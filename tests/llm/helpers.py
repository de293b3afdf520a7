"""Small fixtures for the training-data operators."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

HARD = [
    None,
    "",
    " \t\r\n\v\f ",
    "word",
    "a b",
    "x" * 30_000,
    "to be or not to be " * 3000,
    "Ünïcödé ΑΣ ὈΔΥΣΣΕΎΣ İstanbul ǅ ﬁ naïve é 中文字符 ことば 한국어 🎉🎉 ‍ \x00 \x1c\x1d\x85\xa0　",
    "it's we'll you're I'd 3.14 1,000 __init__ <|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>",
    "line one\nline one\n\nline two\r\nline one",
]


def documents(spark, texts, extra=""):
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def stored(tmp_path, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
