import random
import re
from collections import Counter

import pytest
import xxhash

from brindle.llm import simhash_dedup as S

DOCS = "doc_id long, text string, lang string, fp string, root long"


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """fps: list of (doc_id, fingerprint) -> smallest id of the component, by row."""
    parent = list(range(len(fps)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                parent[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            low[top(i)] = min(low.get(top(i), d), d)
    return [low.get(top(i)) for i in range(len(fps))]


def expected(rows):
    fps = [(r[0], brute_fingerprint(r[1])) for r in rows]
    return Counter((d, f"{f:016x}", c) for (d, f), c in zip(fps, brute_components(fps), strict=True))


def test_real_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = Counter(map(tuple, S.near_duplicates(docs).collect()))
    assert got == expected(rows)


def test_edge_rows_and_clashing_columns(spark):
    long = " ".join(f"w{i % 977}" for i in range(40_000))
    rows = [(5, None), (3, ""), (4, " \t\n"), (9, "One"), (9, "One"), (None, "one"), (7, "a b"), (8, "a b c"), (1, long), (2, long + " x")]
    docs = spark.createDataFrame([(*r, "en", "x", 1) for r in rows], DOCS)
    assert Counter(map(tuple, S.near_duplicates(docs).collect())) == expected(rows)
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    left = [r.doc_id for r in kept.collect()]
    assert len(left) == len({r[2] for r in expected(rows)}) and 3 in left and 9 in left


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert S.near_duplicates(docs).collect() == [] and S.keep_one(docs).collect() == []


@pytest.mark.parametrize("limit", [3, 8192])
def test_links_equal_brute_force_also_when_buckets_are_cut_again(spark, limit):
    rnd = random.Random(5)
    fps = set()
    for _ in range(6):
        f = rnd.getrandbits(64)
        for _ in range(25):
            fps.add(f)
            for _ in range(rnd.choice([1, 2, 2, 3])):
                f ^= 1 << rnd.randrange(64)
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = S.near_links(spark.createDataFrame(signed, "fp long"), limit)
    comp = {r.node: r.root for r in S.components(edges).collect()}
    want = brute_components([(i, f) for i, f in enumerate(fps)])
    groups, brute = {}, {}
    for (s,), w, i in zip(signed, want, range(len(fps)), strict=True):
        groups.setdefault(comp.get(s, s), set()).add(i)
        brute.setdefault(w, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))
