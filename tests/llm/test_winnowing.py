import hashlib
import random
import re
from collections import Counter

from brindle.llm import winnowing as W

DOCS = "doc_id long, text string, lang string, w string, hash long, rid string"
ITEMS = "item_id long, text string, kind int"


def brute(docs, items):
    cut = lambda t: re.findall(W.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for i, t in items:
        w = cut(t)
        k = min(10, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[j : j + k]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, ids = cut(t), set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if (found := windows.get(tuple(w[j : j + k]))) is not None:
                    hit.update(range(j, j + k))
                    ids |= {str(x) for x in found if x is not None}
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(*r, "en", "x", 1, "y") for r in docs], DOCS)
    i = spark.createDataFrame([(*r, 7) for r in items], ITEMS)
    return Counter(map(tuple, W.decontaminate(d, i, **more).collect()))


def planted(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "naïve", "x9"]
    text = lambda n: " ".join(rnd.choice(vocabulary).title() for _ in range(n))
    items = [(i, text(rnd.choice([1, 3, 9, 10, 11, 25, 40]))) for i in range(14)] + [(20, None), (21, ""), (None, text(12)), (22, "--")]
    items += [items[3], (77, items[4][1]), (78, items[5][1].upper())]
    docs = [(0, None), (1, ""), (2, "... \x00 --"), (None, text(40))]
    for d in range(40):
        body = text(rnd.choice([3, 9, 10, 30, 200])).split()
        for _ in range(rnd.choice([0, 1, 1, 4])):
            source = (rnd.choice(items)[1] or "").split()
            a = rnd.randrange(max(1, len(source)))
            at = rnd.randrange(len(body) + 1)
            body[at:at] = source[a : a + rnd.choice([5, 9, 10, 11, 40])]
        docs.append((d + 3, ", ".join(body)))
    docs += [docs[-1], docs[-1], (500, " ".join([items[6][1]] * 3)), (501, text(30_000) + " " + items[5][1])]
    return docs, items


def test_brute_force_on_planted_spans(spark):
    for seed in (1, 2):
        docs, items = planted(seed)
        assert run(spark, docs, items) == brute(docs, items)


def test_shuffled_join_gives_the_same(spark):
    docs, items = planted(3)
    assert run(spark, docs, items, broadcast_bytes=0) == brute(docs, items)


def test_a_passage_that_all_share_is_dealt_out(spark):
    """Every document and very many items have one passage; the shuffled join has a marker key for each document."""
    passage = " ".join(f"p{i}" for i in range(30))
    docs = [(i, f"a{i} {passage} b{i}") for i in range(400)] + [(1000 + i, f"clean {i}") for i in range(400)]
    items = [(i % 50, f"{passage} {i}") for i in range(200)]
    assert run(spark, docs, items, broadcast_bytes=0) == brute(docs, items)
    d = spark.createDataFrame([(*r, "en", "x", 1, "y") for r in docs], DOCS)
    i = spark.createDataFrame([(*r, 7) for r in items], ITEMS)
    contexts, items_of, _ = W.benchmark_contexts(i)
    assert contexts.count() <= 60 + 200 * 15 and items_of.groupBy("c0", "c1").count().agg({"count": "max"}).first()[0] == 50
    keys = W._met_fingerprints(d.selectExpr("doc_id", "doc_id as rid", "split(lower(text), ' ') as w"), contexts, [])
    marked = keys.selectExpr("hash(-1, rid) as key").distinct().count()
    assert marked == 800  # as many keys as documents


def test_every_span_of_ten_words_is_found(spark):
    rnd = random.Random(4)
    words = [f"t{i}" for i in range(60)]
    docs = []
    for a in range(51):
        noise = [f"n{rnd.random()}" for _ in range(20)]
        docs.append((a, " ".join(noise[:7] + words[a : a + 10] + noise[7:])))
        docs.append((100 + a, " ".join(noise[:7] + words[a : a + 9] + noise[7:])))
    got = {r[0]: r[2] for r in run(spark, docs, [(1, " ".join(words))])}
    assert all(got[a] == 10 and got[100 + a] == 0 for a in range(51))


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c")]) == Counter()
    docs = [(1, "a b c"), (2, None)]
    assert run(spark, docs, []) == brute(docs, [])
