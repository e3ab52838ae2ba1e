import itertools
import random
import re
import time
from collections import Counter

from brindle.llm import url_rules as U

PAGES = "page_id long, url string, html string, host int, id string"


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "<p>", 1, "x") for i, u in enumerate(urls)], PAGES)


def brute_parts(url):
    found = re.fullmatch(r"(.*?)://([^/?#]*)([^?#]*)(.*)", url or "", re.DOTALL)
    return (re.sub("[A-Z]", lambda m: m[0].lower(), found[2]), found[3]) if found else ("", "")


def brute_rule(host, path):
    fits = []
    for rule, verdict in U.EXPLICIT.items():
        at, _, start = rule.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith("/" + start):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


ODD = [None, "", "no mark", "://", "http://", "HTTP://A.Example.NET/en/x?y#z", "http://example.net", "http://example.net/en", "http://xexample.net/en/",
       "http://net/", "http://a.net?x=://b.org/fr/", "http://www.example.com/de/1", "http://www.example.com/DE/1", "x://org/fr/", "http://a.org#/fr/", "http://É.ORG/fr/é", "a://b://c/d"]


def test_hosts_paths_and_explicit_rules(spark, sf_dir):
    urls = ODD + [r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()] + ["http://x.net/" + "a/" * 40_000]
    got = U.judge(frame(spark, urls), U.Mined([], {}), U.EXPLICIT).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = brute_parts(urls[r.page_id])
        rule, verdict = brute_rule(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")


def brute_rules(rows, longest):
    """Every combination of tokens, minimal ones only, in the order of their length."""
    baskets = [(set(U.url_tokens(u)), b) for u, b in rows]
    all_bad, kept = sum(b for _, b in baskets), {}
    every = sorted({t for ts, b in baskets if b for t in ts})
    for k in range(1, longest + 1):
        for tokens in itertools.combinations(every, k):
            hit = [b for t, b in baskets if t.issuperset(tokens)]
            if U.passes(sum(hit), len(hit), all_bad, len(rows)) and not any(set(r) < set(tokens) for r in kept):
                kept[tokens] = (sum(hit) / len(hit), sum(hit))
    return kept


def rounded(rules):
    return {r: (round(c, 9), n) for r, (c, n) in rules.items()}


def labelled(spark, rows):
    return spark.createDataFrame(rows, "url string, bad boolean")


def test_mined_rules_equal_brute_force(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(400):
        host = rnd.choice(["casino-win.example.com", "news.example.org", "blog.example.com"])
        ending, query = rnd.choice(["", ".html"]), rnd.choice(["", "?page=2"])
        bad = host.startswith("casino") or (host.startswith("blog") and query and ending)
        rows.append((f"http://{host}/en/{i}{ending}{query}", bool(bad) != (rnd.random() < 0.03)))
    mined = U.mine(labelled(spark, rows))
    got = mined.spelled_out()
    assert rounded(got) == rounded(brute_rules(rows, 3)) and any("word:casino" in r for r in got) and any(len(r) == 3 for r in got)

    held_out = [(f"http://casino-win.example.com/en/{i}", "block") for i in range(9000, 9020)]
    held_out += [(f"http://news.example.org/en/{i}.html", "allow") for i in range(9000, 9020)]
    verdicts = U.judge(frame(spark, [u for u, _ in held_out]), mined, {}).collect()
    assert [r.verdict for r in sorted(verdicts)] == [v for _, v in held_out]


def test_long_shared_paths_and_many_items(spark):
    """All tokens count, also those far along a path, and FP-growth ends."""
    rnd = random.Random(4)
    shared = "/".join(f"seg{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40))
    rows = [(f"http://a.example/{shared}/{rnd.choice('xyz')}/tail{'bad' if i % 3 == 0 else 'good'}", i % 3 == 0) for i in range(300)]
    began = time.monotonic()
    got = U.mine(labelled(spark, rows)).spelled_out()
    assert time.monotonic() - began < 60
    assert ("path:tailbad",) in got and rounded(got) == rounded(brute_rules(rows, 1))

    flags = "abcdefghijklmnopqrst"  # each URL has its own choice of many segments, so none are equal; bad is what has three of them
    rows = []
    for i in range(150):
        have = rnd.sample(flags, 14)
        rows.append((f"http://a.example/{'/'.join(sorted(have))}/{i}", {"a", "g", "p"} <= set(have)))
    got = U.mine(labelled(spark, rows)).spelled_out()
    want = brute_rules(rows, 3)
    assert ("path:a", "path:g", "path:p") in want and rounded({r: x for r, x in got.items() if len(r) <= 3}) == rounded(want)


def test_cover_holds_every_three_items():
    items = [f"i{k:02}" for k in range(23)]
    parts = [set(p) for p in U.baskets_of(items)]
    assert max(map(len, parts)) <= U.FIT_ITEMS
    assert all(any(p.issuperset(c) for p in parts) for c in itertools.combinations(items, U.COVER))
    assert list(U.baskets_of(items[:12])) == [items[:12]]


def test_index_equals_trying_every_rule():
    rnd = random.Random(2)
    rules = [tuple(sorted(rnd.sample("abcdefgh", rnd.randrange(1, 4)))) for _ in range(30)]
    index = U.RuleIndex(rules)
    for _ in range(300):
        tokens = rnd.sample("abcdefgh", rnd.randrange(0, 6))
        assert index.match(tokens) == any(set(r) <= set(tokens) for r in rules)
        assert sorted(index.matches(tokens)) == [i for i, r in enumerate(rules) if set(r) <= set(tokens)]


def test_chance_makes_no_rules(spark):
    rnd = random.Random(6)
    rows = [(f"http://h{rnd.randrange(60)}.example/{rnd.choice('abc')}/{i}", rnd.random() < 0.6) for i in range(600)]
    assert U.mine(labelled(spark, rows)).rules == []


def test_labels_reach_pages_and_empty_tables(spark):
    urls = [f"http://free-bets.example.com/en/{i}" for i in range(30)] + [f"http://ok.example.com/en/{i}" for i in range(30, 90)]
    labels = [(i, 0 if i < 30 else 1, None) for i in range(60)] + [(None, 0, 1), (3, 0, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = U.filter_pages(frame(spark, urls), table).collect()
    assert Counter(r.verdict for r in got) == {"block": 30, "allow": 60}
    none = spark.createDataFrame([], table.schema)
    assert {r.verdict for r in U.filter_pages(frame(spark, urls), none).collect()} == {"allow"}
    assert U.filter_pages(frame(spark, []), table).collect() == []
