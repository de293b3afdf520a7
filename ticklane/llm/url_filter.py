"""URL filter: host and path rules, else naive Bayes over segmented names.

Names in host and path are split into words by a unigram Viterbi search; the unigrams are the words of a public vocabulary
file with probabilities by rank (Zipf), and the seed words. Multinomial naive Bayes scores the words. It learns from all
given urls: one that has a seed word among its words is an example to block, any other to allow. What is learned is the
company: the words that stand with seed words count against a url, and those of ordinary urls for it. The seed words
themselves learn nothing from the examples they chose; each has the same log ratio, a parameter, that outweighs the prior but
not two or three words of ordinary urls. So a url with a seed word may be allowed for the rest of its words, and one without
any may be blocked. Each class's word probabilities are its counts with `background` further words dealt as in all urls, so
a word as frequent in either class tells nothing, whatever the classes' sizes. The prior is a parameter, not the classes'
sizes. A word that no example to block has gets one ratio, the same for all such words; the ratios of the others are a table
that is joined, and broadcast only if it is counted to be small.

Rows: one output row per input row. Null urls, and those without '://', have an empty host and path, no words, and are
allowed; log odds are null without words. Very long names are segmented whole. Of rules as long as each other the later
listed one holds, of equally probable splits the one with the longest last word. Repeated rows get equal results; an
empty table gives an empty one. Input columns named like an output are replaced.
"""

from __future__ import annotations

import base64
import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import RecentCache, arrow_column, extend, lower_ascii, sized, texts_of, vocabulary_path, written

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words that mark an example to block: gambling, adult content, sham medicine and goods, advertising, unwanted software.
SEEDS = ("ads", "adult", "bet", "bets", "betting", "casino", "cialis", "escort", "gambling", "jackpot", "lottery", "malware", "nude", "phishing", "pills", "poker", "porn", "replica", "sex", "slots", "spam", "viagra", "warez", "xxx")
#: Tables of ratios of at most so many words, as counted, are broadcast.
FEW = 500_000


@dataclass(frozen=True)
class Rule:
    """verdict, and host and path as in 'example.net/en/': fits the host and all subdomains where the path starts with the rule's."""

    verdict: str
    target: str

    def fits(self, host: Column, path: Column) -> Column:
        name, _, rest = self.target.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")


RULES = (Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host and path."""
    address = F.coalesce(F.col(url), F.lit(""))
    return extend(pages, host=lower_ascii(F.regexp_extract(address, r"://([^/?#]*)", 1)), path=F.regexp_extract(address, r"://[^/?#]*([^?#]*)", 1))


def with_rule(parts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """parts with rule and rule_verdict of the longest fitting rule, else null."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.target)):  # the longest stands outermost
        fits = r.fits(F.col("host"), F.col("path"))
        rule, verdict = F.when(fits, r.target).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return extend(parts, rule=rule, rule_verdict=verdict)


class Segmenter:
    """Splits names into the most probable words; letters that fit no word stay together at a cost that grows with their number."""

    def __init__(self, vocabulary: str = VOCABULARY, longest: int = 24, seeds: tuple[str, ...] = SEEDS):
        with open(vocabulary_path(vocabulary), "rb") as f:
            ranked = [base64.b64decode(line.split()[0]) for line in f]
        words = dict.fromkeys(w[1:].decode("ascii").lower() for w in ranked if re.fullmatch(rb" [A-Za-z]{2,}", w))
        self.cost = {w: math.log((i + 1) * math.log(len(words))) for i, w in enumerate(words) if len(w) <= longest}
        rarest = max(self.cost.values())
        self.cost |= {w: rarest for w in seeds if w not in self.cost}
        self.longest, self.unknown = longest, 2 * math.log(len(words))
        self.cache = RecentCache(lambda names: [tuple(self.split(x)) for x in names], limit=100_000)

    def split(self, name: str) -> list[str]:
        best, start = [0.0], [0]
        for end in range(1, len(name) + 1):
            options = [(best[end - 1] + self.unknown, end - 1)]
            for at in range(max(0, end - self.longest), end - 1):
                if (c := self.cost.get(name[at:end])) is not None:
                    options.append((best[at] + c, at))
            cost, at = min(options)
            best.append(cost)
            start.append(at)
        out, end, loose = [], len(name), len(name)
        while end:
            at = start[end]
            if end - at > 1:
                out += ([name[end:loose]] if loose > end else []) + [name[at:end]]
                loose = at
            end = at
        return (out + ([name[:loose]] if loose else []))[::-1]

    def words(self, host: str, path: str) -> list[str]:
        names = re.findall("[a-z]+", host) + re.findall("[a-z]+", path.lower())
        return [w for found in self.cache.many(names) for w in found]


def with_words(parts: DataFrame, vocabulary: str = VOCABULARY, name: str = "words") -> DataFrame:
    """parts with the segmented words of host and path."""

    def start():
        segmenter = Segmenter(vocabulary)
        return lambda hosts, paths: pa.array([segmenter.words((h or b"").decode("utf-8", "replace"), (p or b"").decode("utf-8", "replace")) for h, p in zip(texts_of(hosts), texts_of(paths))], pa.list_(pa.string()))

    return extend(parts, **{name: arrow_column(start, "array<string>", inputs=2)(F.col("host"), F.col("path"))})


@dataclass
class Bayes:
    """prior: log odds to block before any word; unseen: log ratio P(word|block)/P(word|allow) of words that no example to block has; ratios: (word, ratio) of all others."""

    prior: float
    unseen: float
    ratios: DataFrame


def fit(segmented: DataFrame, seeds: tuple[str, ...] = SEEDS, background: float = 100.0, seed_ratio: float = 3.0, prior: float = math.log(1 / 9)) -> Bayes:
    """Learns from all rows. The prior's default takes one url in ten to be one to block; seed_ratio is the log ratio of each seed word."""
    spark = segmented.sparkSession
    block = F.arrays_overlap("words", F.array(*map(F.lit, seeds))).cast("long")
    words = segmented.select(block.alias("block"), F.explode("words").alias("word")).where(~F.col("word").isin(*seeds))
    counts = written(words.groupBy("word").agg(F.count("*").alias("n"), F.sum("block").alias("block")))
    every, blocked = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("block"), F.lit(0))).first()
    p = lambda n, of: (n + background * F.col("n") / max(every, 1)) / (of + background)
    ratios = counts.where("block > 0").select("word", F.log(p(F.col("block"), blocked) / p(F.col("n") - F.col("block"), every - blocked)).alias("ratio"))
    marked = spark.createDataFrame([(w, seed_ratio) for w in seeds], "word string, ratio double")
    unseen = math.log(background / (blocked + background)) - math.log((every + background) / (every - blocked + background))
    return Bayes(prior, unseen, ratios.union(marked))


def judge(segmented: DataFrame, model: Bayes, block_at: float = 0.0) -> DataFrame:
    """segmented with log_odds and verdict: the rule's if a rule fits, else block where log_odds exceed block_at and there are words. Rows are numbered in a written table, their words joined to the ratios, and each row's sum joined back."""
    rows = written(segmented.withColumn("_row", F.monotonically_increasing_id()))
    words = rows.select("_row", F.explode("words").alias("word")).join(sized(model.ratios, FEW), "word", "left")
    odds = words.groupBy("_row").agg((F.sum(F.coalesce("ratio", F.lit(model.unseen))) + model.prior).alias("_odds"))
    scored = extend(rows.join(odds, "_row", "left"), log_odds=F.col("_odds")).drop("_row", "_odds")
    return extend(scored, verdict=F.coalesce("rule_verdict", F.when(F.col("log_odds") > block_at, "block").otherwise("allow")))
