import math
import random
import re
from collections import Counter

import pytest

from ticklane.llm import queries, url_filter

from .helpers import stored

URLS = [
    None,
    "",
    "no scheme/en/",
    "http://EXAMPLE.net/en/1?x=/fr/",
    "https://a.example.net/EN/1",
    "https://net",
    "https://net/",
    "https://notnet/x",
    "https://www.example.com/de/9#top",
    "https://www.example.com/DE/9",
    "https://sub.shop.org/fr/://x",
    "x://y://z/w?q",
    "http://h?q#f",
    "http://host\nname/p\nq?z",
    "https://www.casino-win.example.org/en/1",
    "https://casinowin.example.org/en/2",
    "https://library.example.org/en/3",
    "https://" + "verylongname" * 400 + ".org/a",
]
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def brute(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fit, key=len, default=None)


def test_parts_rules_and_verdicts(spark, tmp_path):
    many = URLS + ["https://www.casino-win.example.org/en/1"] + [f"https://{w}.example.org/en/{i}" for i, w in enumerate(["garden", "city-library", "cooking", "history"] * 10)]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(many)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in queries.op2_url_filter(spark, stored(tmp_path, pages=pages)).collect()}
    assert len(rows) == len(many)
    for i, u in enumerate(many):
        host, path, rule = brute(u)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule), u
        assert rows[i].verdict == RULES[rule] if rule else rows[i].verdict in ("block", "allow")
    assert [rows[i].verdict for i in (14, 15, 16)] == ["block", "block", "allow"]
    assert {rows[i].verdict for i in (0, 1, 2)} == {"allow"}


def test_segmentation():
    s = url_filter.Segmenter()
    assert s.split("freebets") in (["free", "bets"], ["free", "bet", "s"]) and s.split("cheappills") == ["cheap", "pills"]
    assert s.split("onlinecasino") == ["online", "casino"] and s.split("") == []
    for name in ("qzx", "zzzzhousezzzz", "a"):
        assert "".join(s.split(name)) == name


def test_empty_table_and_clash(spark):
    pages = spark.createDataFrame([(1, "https://x.net/")], "page_id long, url string").selectExpr("*", "'h' as HOST", "'v' as verdict")
    run = lambda p: url_filter.judge((w := url_filter.with_words(url_filter.with_rule(url_filter.with_parts(p)))), url_filter.fit(w))
    row = run(pages).first()
    assert (row["host"], row["verdict"]) == ("x.net", "block") and run(pages.limit(0)).count() == 0


def test_log_odds_equal_brute_force(spark):
    r = random.Random(4)
    names = ["casino", "win", "garden", "library", "cheap", "pills", "history", "market"]
    urls = [f"https://www.{r.choice(names)}{r.choice(['-', ''])}{r.choice(names)}.example.org/en/{r.choice(names)}" for _ in range(200)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    w = url_filter.with_words(url_filter.with_rule(url_filter.with_parts(pages)))
    rows = url_filter.judge(w, url_filter.fit(w)).collect()
    n, block = Counter(), Counter()
    for row in rows:
        company = [w for w in row["words"] if w not in url_filter.SEEDS]
        n.update(company)
        block.update(company if set(row["words"]) & set(url_filter.SEEDS) else [])
    total, blocked = sum(n.values()), sum(block.values())
    p = lambda word, k, of: (k + 100 * n[word] / total) / (of + 100)
    ratio = lambda x: 3.0 if x in url_filter.SEEDS else math.log(p(x, block[x], blocked) / p(x, n[x] - block[x], total - blocked))
    for row in rows:
        expected = math.log(1 / 9) + sum(map(ratio, row["words"]))
        assert row["log_odds"] == pytest.approx(expected)
    assert {r["verdict"] for r in rows} == {"block", "allow"}


def judged(spark, planted, sf="sf0.1"):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").select("page_id", "url")
    both = pages.union(spark.createDataFrame([(-i, u) for i, u in enumerate(planted, 1)], pages.schema))
    w = url_filter.with_words(url_filter.with_rule(url_filter.with_parts(both)))
    return url_filter.judge(w, url_filter.fit(w))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_stored_urls_without_a_rule_get_both_verdicts(spark, sf):
    rows = judged(spark, [], sf).where("rule is null").collect()
    assert 0.01 < sum(r.verdict == "block" for r in rows) / len(rows) < 0.3
    assert all((r.log_odds or -1) > 0 if r.verdict == "block" else (r.log_odds or -1) <= 0 for r in rows)


def test_the_company_of_words_decides(spark):
    """Words of stored urls that stand with seed words block a url without one; words of ordinary urls outweigh a single seed word."""
    seedless = ["https://www.cheapfreewin.example.org/en/1", "https://win-cheap.example.org/es/2"]
    harmless = ["https://blog.thertion.ththble.tionsh.ththhe.adult.example.org/en/3"]
    rows = {r.page_id: r for r in judged(spark, [*seedless, *harmless, "https://casinowin.example.org/en/4", "https://publiclibrary.example.org/en/5"]).where("page_id < 0").collect()}
    seeded = lambda i: bool(set(rows[i]["words"]) & set(url_filter.SEEDS))
    assert [(rows[-i].verdict, seeded(-i)) for i in range(1, 6)] == [("block", False), ("block", False), ("allow", True), ("block", True), ("allow", False)]


def test_names_run_together_are_blocked_on_stored_urls(spark):
    planted = ["https://cheappills.example.org/en/1", "https://www.casinowin.example.org/es/2", "https://m.freebets.example.org/en/3", "https://publiclibrary.example.org/en/4", "https://www.gardenhistory.example.org/en/5", "https://sussexnews.example.org/en/6"]
    found = {r.page_id: r.verdict for r in judged(spark, planted).where("page_id < 0").collect()}
    assert [found[-i] for i in range(1, 7)] == ["block"] * 3 + ["allow"] * 3
