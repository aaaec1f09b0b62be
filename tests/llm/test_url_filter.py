"""URL splitting and fixed rules against plain Python, mined rules against counting, and edge cases."""

import itertools
import random

import pytest

from fieldwarden.llm import queries, url_filter
from fieldwarden.llm.url_filter import ALLOW, BLOCK

URLS = [
    "http://example.net/en/1",
    "https://WWW.Example.NET/en/2?x=/de/",
    "https://www.example.net/EN/3",
    "https://badexample.net/x",
    "http://net/",
    "http://a.net",
    "http://a.net?/x",
    "https://m.example.com/de/5#top",
    "https://m.example.com/dex",
    "ftp://q.org/fr/ü?y://z",
    "://x.org/fr/",
    "no scheme.net/en/",
    "http:///path",
    "http://h#frag/ment",
    "http://É.Net/De",
    "",
    None,
    "http://x.net/" + "seg/" * 50_000,
]


def plain_judged(url):
    """Host, path and winning rule."""
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host = rest[: min(ends, default=len(rest))]
    path = rest[len(host) :]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = []
    for _, rule in queries.URL_RULES:
        name, start = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            fits.append(rule)
    return host, path, max(fits, key=len, default=None)


def pages(spark, urls):
    return spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").repartition(4)


def test_host_path_and_longest_rule(spark):
    verdicts = dict((rule, verdict) for verdict, rule in queries.URL_RULES)
    got = url_filter.judge(pages(spark, URLS), queries.URL_RULES, carry=["page_id"]).collect()
    assert len(got) == len(URLS)
    for r in got:
        url = URLS[r["carried"]["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == plain_judged(url)
        assert r["verdict"] == verdicts[r["rule"]] if r["rule"] else r["verdict"] in (ALLOW, BLOCK)
        assert r["url"] == url


def labelled(seed, n=600):
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        host = draw.choice(("good.org", "shop.biz", "casino.biz", "mixed.com"))
        lang, kind = draw.choice(("en", "de")), draw.choice(("news", "bets"))
        block = host == "casino.biz" or (kind == "bets" and lang == "de")
        out.append((f"https://{host}/{lang}/{kind}/{draw.randrange(50)}", BLOCK if block != (draw.random() < 0.01) else ALLOW))
    return out


def counted_rules(rows, support, confidence):
    """Every rule of at most four tokens by plain counting, without those that say nothing new."""
    sets = [(frozenset(url_filter.tokens(u)), label) for u, label in rows]
    found = {}
    for size in range(1, 5):
        for combo in {frozenset(c) for s, _ in sets for c in itertools.combinations(sorted(s), size)}:
            held = [label for s, label in sets if combo <= s]
            for label in set(held):
                n = held.count(label)
                if n / len(rows) >= support and n / len(held) >= confidence:
                    found[combo, label] = n / len(held)
    return {
        (tuple(sorted(c)), label): sure
        for (c, label), sure in found.items()
        if not any(found.get((c - {t}, label), 0) >= sure for t in c)
    }


def test_mined_rules_equal_counting(spark):
    rows = labelled(4)
    table = spark.createDataFrame(rows, "url string, label string").repartition(3)
    got = {(tuple(r["tokens"]), r["verdict"]): r["confidence"] for r in url_filter.mined_rules(table, 0.02, 0.9).collect() if len(r["tokens"]) <= 4}
    want = counted_rules(rows, 0.02, 0.9)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert any("bets" in " ".join(k[0]) and len(k[0]) > 1 for k in got)


def test_rules_carry_over_to_new_urls(spark):
    table = spark.createDataFrame(labelled(5), "url string, label string")
    fresh = labelled(6, 200)
    got = url_filter.judge(pages(spark, [u for u, _ in fresh]), (), table, carry=["page_id"]).collect()
    right = sum(r["verdict"] == fresh[r["carried"]["page_id"]][1] for r in got)
    blocked = [r for r in got if fresh[r["carried"]["page_id"]][1] == BLOCK]
    assert right >= 0.95 * len(fresh)
    assert sum(r["verdict"] == BLOCK for r in blocked) >= 0.9 * len(blocked) > 0
    assert all(r["mined_rule"] and r["confidence"] >= 0.9 for r in blocked if r["verdict"] == BLOCK)


def test_index_finds_what_a_search_of_all_rules_finds(spark):
    rules = url_filter.mined_rules(spark.createDataFrame(labelled(7), "url string, label string"), 0.01, 0.6).collect()
    index = url_filter._index(rules)
    assert sum(map(len, index.values())) == len(rules)
    for url, _ in labelled(8, 100):
        own = set(url_filter.tokens(url))
        every = sorted((-r["confidence"], -r["support"], r["verdict"] != BLOCK, r["tokens"]) for r in rules if set(r["tokens"]) <= own)
        first = min((r[0] for t in own if t in index for r in index[t] if r[1] <= own), default=None)
        assert first == (every[0] if every else None)


@pytest.mark.parametrize("rows", [[], [(None, BLOCK), ("http://a.b/c", None)]])
def test_without_labels_the_default_holds(spark, rows):
    table = spark.createDataFrame(rows, "url string, label string")
    got = url_filter.judge(pages(spark, URLS), (), table).collect()
    assert {r["verdict"] for r in got} == {ALLOW} and len(got) == len(URLS)


def test_empty_table_and_clashing_columns(spark):
    given = pages(spark, URLS).selectExpr("*", "1 as host", "2 as tokens", "3 as carried", "4 as label", "5 as row")
    assert url_filter.judge(given, queries.URL_RULES, carry=["page_id", "carried"]).count() == len(URLS)
    assert url_filter.judge(given.limit(0), queries.URL_RULES).count() == 0


def test_one_url_many_times(spark):
    many = ["https://a.casino.biz/" + "/".join(f"p{i}" for i in range(40)) + "?" + "&".join(f"k{i}=1" for i in range(40))] * 400
    table = spark.createDataFrame([(u, BLOCK) for u in many] + [("https://good.org/en", ALLOW)] * 50, "url string, label string")
    got = url_filter.judge(pages(spark, many[:3]), (), table).collect()
    assert [r["verdict"] for r in got] == [BLOCK] * 3
