import html
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from brindle.llm import host_boilerplate as H

PAGES = "page_id long, url string, html string, text string, host int, rid string"


def run(spark, rows, **more):
    pages = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], PAGES).repartition(3)
    return {r.page_id: r.text for r in H.extract(pages, **more).collect()}


def test_real_pages_equal_their_articles(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in H.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", article)]
        text = "\n".join(b for b in blocks if b)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (text, len(text), r.url)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a &lt;b&gt; &eacute;&#233;&nbsp;x \n y</p><p> </p><p>z", "a <b> éé x y\nz"),
        ("<nav>m</nav><article><h1>T</h1><p>one<p>two <b>bold</b>!<script>if(a<b){}</script></article><footer>f</footer>", "T\none\ntwo bold!"),
        ("<article><p>x</p><div class='cookie-notice'>c</div><aside>s</aside><form><p>f</p></form><p>y</p><section id=comments><p>c</p></section></article>", "x\ny"),
        ("<main><ul><li>a<li>b</ul></main><div>out</div>", "a\nb"),
        ("<article><p>real</p></article><article class='comment'><p>reader</p></article>", "real"),
        ("<article><p>1 < 2 <!-- <p>no</p> --> ok</article>", "1 < 2 ok"),
        ('<article><p title="a>b">t</p></article><p>after', "t"),
        ('<form id="aspnetForm"><article><p>x</p></article><p>f</p></form>', "x"),
        ('<div class="layout has-sidebar"><article><p>x</p></article></div>', "x"),
        ('<article><div class="share-price">1.5</div><p class="search">y</p><p class="ad">z</p></article>', "1.5\ny"),
        ('<article class="advert"><p>buy</p></article><article><p>x</p></article>', "x"),
        ('<article><p>x</p></article><div class="comment-list"><article><p>r</p></article></div>', "x"),
        ("<article><p>x <button>press</button> y</p></article>", "x y"),
        ("<div class=ad>buy</div><p>kept</p><div class='add reader'>also</div>", "kept\nalso"),
    ],
)
def test_markup(page, text):
    assert "\n".join(t for t, kind in H.parse(page) if kind != H.OUT) == text


@pytest.mark.parametrize(
    "page",
    [
        "<a " * 400_000,
        "<b>" * 300_000 + "</i>" * 300_000,
        "<b>" * 200_000 + "<p>x" * 200_000,
        "<script" * 200_000,
        "<a\"" * 400_000,
        "<a title='" * 200_000,
        "<p class" + " " * 1_000_000 + "=x" * 100_000 + ">",
        "<div>" * 300_000 + "x" + "</div>" * 200_000,
        "&amp" * 300_000 + "<!--" * 300_000,
    ],
)
def test_malformed_pages_take_time_in_proportion(page):
    began = time.process_time()
    H.parse(page)
    assert time.process_time() - began < 10


def test_the_suffix_array_decides(spark, monkeypatch):
    rows, want = no_article_pages()
    assert run(spark, rows) == want
    found = {r.page_id: r for r in H.extract(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], PAGES)).collect()}
    assert found[0].n_removed == found[0].n_repeated == 28 and found[103].n_repeated == 14 and found[103].n_removed == 0
    off = [[b for b in H.parse(h or "")] for _, u, h in rows if u and "hTrue" in u]
    monkeypatch.setattr(H, "repeated_starts", lambda *a: np.empty(0, np.int64))
    assert [t for t, _, _ in H.host_texts(off)][0] != want[0]


def test_short_blocks_go_only_when_covered_wholly():
    menu = [(x, H.ASK) for x in "home about us contact privacy terms of use jobs".split()]
    pages = [[*menu, (f"first {i} {'uvw'[i % 3]}{i} word{i}", H.ASK), ("out of it", H.OUT)] for i in range(8)]
    got = H.host_texts(pages)
    assert [t for t, _, _ in got] == [f"first {i} {'uvw'[i % 3]}{i} word{i}" for i in range(8)]
    assert all((r, g) == (10, 9) for _, r, g in got)  # the run goes on to "first", whose block is not covered wholly


def no_article_pages():
    rnd = random.Random(3)
    unique = lambda n: " ".join(f"u{rnd.randrange(10**9)}" for _ in range(n))
    notice = "we use little biscuits on this site to make it nicer for you all"
    rows, want = [], {}
    for i in range(60):
        own, tail = unique(30), unique(5)
        rows.append((i, f"http://h{i % 3 == 0}.com/{i}", f"<div>{notice}</div><div>{own}</div><div>{notice} {tail}</div>"))
        want[i] = f"{own}\n{tail}"
    copy = f"<div>{unique(20)}</div>"
    rows += [(100, "http://hTrue.com/c", copy), (101, "http://hTrue.com/d", copy), (102, "http://alone.org/", f"<div>{notice}</div>")]
    want |= {100: copy[5:-6], 101: copy[5:-6], 102: notice}
    article = f"<article><p>{notice}</p></article>"
    rows += [(103, "http://hTrue.com/e", article), (104, None, f"<div>{notice}</div>"), (105, "http://x.y/", None), (106, "http://x.y/", "")]
    return rows, want | {103: notice, 104: notice, 105: "", 106: ""}


@pytest.mark.parametrize("part_bytes", [H.PART_BYTES, 14_000])
def test_repeated_runs_go_and_unique_runs_stay(spark, part_bytes):
    rows, want = no_article_pages()
    assert run(spark, rows, part_bytes=part_bytes) == want


def test_near_copies_and_shared_passages_stay(spark):
    rnd = random.Random(5)
    unique = lambda n: " ".join(f"u{rnd.randrange(10**9)}" for _ in range(n))
    notice, passage, copy = unique(12), unique(50), unique(40)
    own = {i: unique(20) for i in range(20)}
    own |= {3: f"{own[3]} {passage}", 8: f"{own[8]} {passage}", 11: f"{own[11]} {passage}", 14: f"{copy} one {own[1][:9]}", 15: f"{copy} two {own[1][:9]}"}
    rows = [(i, f"http://a.b/{i}", f"<div>{notice}</div><p>{t}</p>") for i, t in own.items()]
    rows += [(100 + i, f"http://two.org/{i}", f"<p>{copy} {i}</p>") for i in range(2)]
    assert run(spark, rows) == own | {100 + i: f"{copy} {i}" for i in range(2)}


def test_suffixes_equal_brute_force():
    rnd = np.random.default_rng(4)
    for depth in (1, 2, 3, 5, 8):
        streams = [rnd.integers(0, 3, rnd.integers(1, 40)) for _ in range(12)]
        streams.append(streams[3])
        owners: dict[tuple, set] = {}
        for s in streams:
            for p in range(s.size - depth + 1):
                owners.setdefault(tuple(s[p : p + depth]), set()).add(tuple(s))
        different = {tuple(s): i for i, s in enumerate(streams)}
        number = {s: i for i, s in enumerate(different)}
        owner = np.repeat(np.arange(len(streams)), [s.size for s in streams])
        hit = H.repeated_starts(np.concatenate(streams), owner, np.array([number[tuple(s)] for s in streams]), depth, 2).tolist()
        want, at = [], 0
        for s in streams:
            want += [at + p for p in range(s.size - depth + 1) if len(owners[tuple(s[p : p + depth])]) > 1]
            at += s.size
        assert hit == want


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "http://a.b/", "<p>same</p>")] * 3
    pages = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], PAGES)
    assert Counter(map(tuple, H.extract(pages).collect())) == {(1, "http://a.b/", "same", 4, 0, 0): 3}
    assert run(spark, []) == {}


def test_results_do_not_depend_on_the_parts_of_a_host(spark):
    """Runs near the share of a large host, whose pages come in copies; parts read as hosts of their own got them wrong."""
    rnd = random.Random(7)
    unique = lambda n: " ".join(f"u{rnd.randrange(10**9)}" for _ in range(n))
    whole, least, less, few = unique(12), unique(12), unique(12), unique(12)
    texts = []
    for i in range(400):
        texts.append(f"<div>{whole}</div>" * (i % 5 > 0) + f"<div>{least}</div>" * (i % 4 == 1) + f"<div>{less}</div>" * (i % 4 == 2 and i > 2) + f"<div>{unique(20)}</div>")
    texts += [f"<div>{few}</div><div>{unique(20)}</div>"] * 150 + [f"<p id={i}>{texts[i % 3]}" for i in range(60)] + ["", None] * 30
    order = rnd.sample(range(len(texts)), len(texts))
    rows = [(i, f"http://a.b/{i}", texts[i]) for i in order] + [(1000 + i, f"http://c.d/{i}", texts[i]) for i in range(90)]
    rows += [(2000 + i, f"http://e.f/{i}", f"<div>{unique(40)}</div>") for i in range(90)]
    results = []
    for part_bytes, partitions in [(H.PART_BYTES, 3), (8_000, 3), (8_000, 5), (1_000, 2)]:
        pages = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], PAGES).repartition(partitions)
        results.append(Counter(map(tuple, H.extract(pages, part_bytes).collect())))
    assert len({r[0] for r in results[0]}) == len(rows) and results[1:] == results[:1] * 3
    joined = {r[0]: r[2] for r in results[0]}
    gone = {run: not any(run in t for i, t in joined.items() if i < 1000) for run in (whole, least, less, few)}
    assert gone == {whole: True, least: False, less: False, few: False}


@pytest.mark.parametrize("part_bytes", [20_000, 2_000])
def test_a_run_on_just_the_share_of_a_host_goes(spark, part_bytes):
    rnd = random.Random(9)
    unique = lambda n: " ".join(f"u{rnd.randrange(10**9)}" for _ in range(n))
    least, less = unique(9), unique(9)
    rows = [(i, f"http://a.b/{i}", f"<div>{least if i < 100 else ''}</div><div>{less if 100 <= i < 199 else ''}</div><p>{i} {unique(9)}</p>") for i in range(400)]
    got = run(spark, rows, part_bytes=part_bytes)
    assert not any(least in t for t in got.values()) and sum(less in t for t in got.values()) == 99


def test_given_runs_equal_brute_force():
    rnd = np.random.default_rng(6)
    for depth in (1, 3, 8):
        streams = [rnd.integers(0, 3, rnd.integers(1, 60)) for _ in range(12)]
        owner, whole = np.repeat(np.arange(12), [s.size for s in streams]), np.concatenate(streams)
        given = np.unique(np.concatenate([[s[:depth] for s in streams if s.size >= depth], [[7] * depth]]), axis=0)[::-1]
        at, which = H.given_starts(whole, owner, given)
        fits = [(p, g) for p in range(whole.size - depth + 1) for g in range(len(given)) if owner[p] == owner[p + depth - 1] and (whole[p : p + depth] == given[g]).all()]
        assert list(zip(at.tolist(), which.tolist(), strict=True)) == fits


def test_a_large_host_is_shuffled_once(spark):
    """The three passes over a host in parts read one shuffle of its blocks."""
    pages = spark.createDataFrame([(i, f"http://a.b/{i}", f"<div>{i} a b c d e f g h i j k</div>", "x", 1, "y") for i in range(300)], PAGES)
    found = H.extract(pages, part_bytes=1_000)
    rows = found.collect()
    assert all(r.n_removed == 11 for r in rows) and len(rows) == 300
    plan = found._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.split("== Initial Plan ==")[0].splitlines() if "REPARTITION_BY_NUM" in line and " Exchange " in line]
    assert len(shuffles) == 3 and sum("ReusedExchange" in line for line in shuffles) == 2
