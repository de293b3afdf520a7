"""License scan with a positional index of rare words, in DataFrame functions only.

Templates (licence phrases and notices) are indexed by word and position. Of each template's mandatory key phrase, the
words of highest inverse document frequency are looked up in each text, as many as must propose a start, so a key phrase
that stands in a text is always proposed; each place of such a word and each posting of it propose a template start.
Starts proposed by enough words are candidates; a candidate counts if the key phrase stands there, word for word.
Everything happens within a row, so no shuffle carries text, and row size alone bounds a task.

Rows: one output row per input row; null text counts as empty. Very long texts are scanned whole. Repeated rows give repeated results, an empty table an
empty one; ties in document frequency are broken by the word. Input columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import extend, lower_ascii


@dataclass(frozen=True)
class Template:
    """words, the mandatory phrase within them, how many words must propose a start, and the score of a full match."""

    label: str
    text: str
    key: str
    need: int = 2
    weight: float = 1.0
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_at(self) -> int:
        words, key = self.words, self.key.split()
        return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


def phrase(label: str, text: str) -> Template:
    return Template(label, text, text, 1, 0.5, True)


#: Phrases, and sentences of public licence notices.
TEMPLATES = (
    phrase("gpl", "gnu general public license"),
    phrase("apache", "apache license"),
    phrase("cc-by", "cc by"),
    phrase("mit", "mit license"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license as published by the free software foundation"),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0", 1),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0", 1),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0", 1),
    Template("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd 4 0", 1),
    Template("mit-short", "released under the mit license", "under the mit license", 1),
    Template("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
)
#: Words too frequent in running text to be looked up.
COMMON = frozenset("a and any are as by can following for form forms free in is it modify of or person program public published purpose released source subject terms that the this to under use used v with without work you 0 2 3 4".split())
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def postings(templates: tuple[Template, ...]) -> dict[str, list[tuple[int, int]]]:
    """word -> (template number, position in it), for all words but common ones."""
    out: dict[str, list[tuple[int, int]]] = {}
    for t, template in enumerate(templates):
        for p, w in enumerate(template.words):
            if w not in COMMON:
                out.setdefault(w, []).append((t, p))
    return out


def _texts(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once for the row and not for each element of a loop in body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def places(words: Column, known: list[str]) -> Column:
    """The places of known licence words among words."""
    found = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(*known))
    return F.when(F.size(words) > 0, found).otherwise(F.array().cast("array<int>"))


def rarity(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text") -> list[str]:
    """The licence words from the highest inverse document frequency over all docs to the lowest; the driver gets one row per licence word at most."""
    present = once(words_of(F.col(text)), lambda words: F.array_distinct(F.transform(places(words, sorted(postings(templates))), lambda i: F.get(words, i))))
    counts = docs.select(F.explode_outer(present).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    found = {r.word: r.n for r in counts}
    return sorted(postings(templates), key=lambda w: (found.get(w, 0), w))


def rarest(templates: tuple[Template, ...], ranked: list[str]) -> list[str]:
    """The words to look up: of each template the rarest words of its key phrase, until `need` of its places are known; all its words, if the key phrase has fewer."""
    rank = {w: i for i, w in enumerate(ranked)}
    out = set()
    for t in templates:
        own = sorted((rank[w], w) for w in t.key.split() if w in rank)
        out.update(w for _, w in own[: t.need])
        if len(own) < t.need:
            out.update(w for w in t.words if w in rank)
    return sorted(out)


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text") -> DataFrame:
    """docs with n_words and the matches: array of (template number, start word, share of the template's words that stand in place)."""
    index = postings(templates)
    few = rarest(templates, rarity(docs, templates, text))
    posted = F.create_map(*[x for w in few for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in index[w]]))])
    table = F.array(*[F.struct(_texts(t.words).alias("words"), F.lit(t.key_at).alias("key_at"), _texts(t.key.split()).alias("key"), F.lit(t.need).alias("need")) for t in templates])

    def proposed(words: Column, at: Column) -> Column:
        """Template starts, equal ones side by side."""
        starts = F.transform(at, lambda i: F.transform(posted[F.get(words, i)], lambda p: F.struct(p["t"].alias("t"), (i - p["p"]).alias("start"))))
        return F.array_sort(F.flatten(starts))

    def enough(starts: Column) -> Column:
        """Each start once, if enough words propose it."""

        def first_of_enough(s: Column, i: Column) -> Column:
            earlier, later = F.get(starts, i - 1), F.get(starts, i + F.get(table, s["t"])["need"] - 1)
            return F.coalesce(earlier != s, F.lit(True)) & F.coalesce(later == s, F.lit(False))

        return F.filter(starts, first_of_enough)

    def matched(words: Column, starts: Column) -> Column:
        def has_key(s: Column) -> Column:
            t = F.get(table, s["t"])
            at = s["start"] + t["key_at"]
            return (at >= 0) & (F.slice(words, F.greatest(at, F.lit(0)) + 1, F.size(t["key"])) == t["key"])

        def in_place(s: Column) -> Column:
            t = F.get(table, s["t"])["words"]
            same = F.size(F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda k: F.coalesce(F.get(words, s["start"] + k) == F.get(t, k), F.lit(False))))
            return F.struct(s["t"].alias("template"), s["start"].alias("start"), (same / F.size(t)).alias("share"))

        return F.transform(F.filter(starts, has_key), in_place)

    def found(words: Column) -> Column:
        starts = once(places(words, few), lambda at: once(proposed(words, at), enough))
        return F.struct(F.size(words).cast("long").alias("n_words"), once(starts, lambda s: matched(words, s)).alias("matches"))

    scanned = extend(docs, _found=once(words_of(F.col(text)), found))
    return extend(scanned, n_words=F.col("_found.n_words"), matches=F.col("_found.matches")).drop("_found")


def summarised(scanned: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """scanned with n_base, first_word, last_word, base_labels, labels (sorted, comma-joined) and score."""
    facts = F.array(*[F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(t.weight).alias("weight")) for t in templates])
    fact = lambda m: F.get(facts, m["template"])
    df = extend(scanned, _base=F.filter("matches", lambda m: fact(m)["base"]))
    labels = lambda name: F.array_join(F.array_sort(F.array_distinct(F.transform(name, lambda m: fact(m)["label"]))), ",")
    starts = F.transform("_base", lambda m: m["start"].cast("long"))
    best = F.array_max(F.transform("matches", lambda m: m["share"] * fact(m)["weight"]))
    return extend(df, n_base=F.size("_base").cast("long"), first_word=F.array_min(starts), last_word=F.array_max(starts), base_labels=labels("_base"), labels=labels("matches"), score=F.coalesce(best, F.lit(0.0))).drop("_base")
