import re

from ticklane.llm import license_scan, queries

from .helpers import HARD, documents, stored

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEXTS = [
    *HARD,
    "MIT License",
    "mit license, mit-license; MIT   LICENSE mit license",
    "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.",
    "gnu general public gnu general public license general public license",
    "license " * 5000 + "gnu " * 5000 + "apache license",
    "cc by " * 3000,
    "élicense mitélicense mit\x00license ccby cc_by",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "permission is hereby given free of charge to any person obtaining a copy of this software and associated documentation files",
]


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_base_columns_and_own_labels(spark, tmp_path):
    texts = [*TEXTS, *TEXTS]
    rows = {r.doc_id: r for r in queries.op4_license_scan(spark, stored(tmp_path, documents=documents(spark, texts))).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        labels = r.labels.split(",")
        assert set(filter(None, r.base_labels.split(","))) <= set(labels) and labels == sorted(set(labels)) and 0 <= r.score <= 1
    own = {i: set(rows[i].labels.split(",")) for i in rows}
    at = len(HARD)
    assert own[at + 2] == {"gpl", "gpl-3.0", "cc-by", "cc-by-nc-4.0"}
    assert own[at + 7] == {"mit-notice"} and rows[at + 7].score == 1.0
    assert own[at + 8] == {""} and rows[at + 8].score == 0.0  # the mandatory phrase is broken


def test_partial_notice_scores_by_its_share(spark):
    notice = "Redistribution and use in source and binary forms, with or without changes, are permitted"
    row = license_scan.summarised(license_scan.scan(documents(spark, [notice]))).first()
    assert row["labels"] == "bsd" and 0.4 < row["score"] < 0.8


def test_empty_table_and_clash(spark):
    docs = documents(spark, ["mit license"]).selectExpr("*", "'x' as N_Words", "'y' as matches")
    assert license_scan.summarised(license_scan.scan(docs)).first()["n_words"] == 2
    assert license_scan.summarised(license_scan.scan(docs.limit(0))).count() == 0


def test_no_python_in_the_plan(spark):
    plan = license_scan.summarised(license_scan.scan(documents(spark, ["mit license"])))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_no_template_loses_its_proposers_to_rarer_words(spark):
    """Each notice stands in one text with all the others; the words of the GPL and Apache notices are frequent elsewhere."""
    notices = {t.label: t.text for t in license_scan.TEMPLATES}
    some = [notices[x] for x in ("mit-notice", "bsd", "apache-2.0", "gpl-3.0")]
    often = ["licensed under the license, general version"] * 30
    texts = [" / ".join(some), " / ".join(notices.values()), *often]
    rows = {r["doc_id"]: r for r in license_scan.summarised(license_scan.scan(documents(spark, texts))).collect()}
    assert {"mit-notice", "bsd", "apache-2.0", "gpl-3.0"} <= set(rows[0]["labels"].split(","))
    assert set(rows[1]["labels"].split(",")) == set(notices)


def test_words_looked_up_follow_the_frequency():
    ranked = sorted(license_scan.postings(license_scan.TEMPLATES))
    for order in (ranked, ranked[::-1]):
        few = license_scan.rarest(license_scan.TEMPLATES, order)
        for t in license_scan.TEMPLATES:
            assert sum(w in few for w in t.words) >= min(t.need, sum(w in ranked for w in t.words))
