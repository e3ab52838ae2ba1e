import math
import random
import re
from collections import Counter

import numpy as np

from brindle.llm import quality_rules as Q
from brindle.llm.common import materialise

DOCS = "doc_id long, text string, lang string, source string, n_words string, key long, level int"


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DOCS)


def test_base_statistics_equal_brute_force(spark, sf_dir):
    rnd = random.Random(2)
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts = [None, "", " \n\t", "a", "a a", "a a a", "a a a a", "a b a b a b", "x\ny\nx\n \n \nx ", "é #|é\x0b<>\x85z", "\x1cq"]
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randrange(40))) for _ in range(60)]
    texts += [" ".join(str(rnd.randrange(40)) for _ in range(30_000))]
    rows += [(10_000 + i, t, None, "s") for i, t in enumerate(texts)] + [(None, "a b", "en", None)]
    got = Q.base_statistics(frame(spark, rows)).collect()
    assert Counter((r.doc_id, *r[3:]) for r in got) == Counter((d, *brute_base(t)) for d, t, *_ in rows)


def test_windows_of_one_hash_are_told_apart(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("abcd") for _ in range(rnd.randrange(40))) for _ in range(40)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    for window_hash in ("0L", "pmod(xxhash64(x), 2)"):
        got = Q.base_statistics(frame(spark, rows), window_hash=window_hash).collect()
        assert Counter((r.doc_id, *r[3:]) for r in got) == Counter((d, *brute_base(t)) for d, t, *_ in rows)


def quantile(x, q):
    """The greatest value of the bin that holds the quantile."""
    x = np.sort(x)
    bins = np.floor(np.log(x + Q.LOWEST) * Q.BINS)
    return x[bins == bins[max(0, math.ceil(q * len(x)) - 1)]].max()


FLOORS = np.array(list(Q.FEATURES.values()))


def factor_of(v):
    """Cholesky factor, a pivot below the least variance raised to it."""
    out = np.zeros_like(v)
    for j in range(len(v)):
        out[j, j] = math.sqrt(max(v[j, j] - (out[j, :j] ** 2).sum(), FLOORS[j] ** 2))
        for i in range(j + 1, len(v)):
            out[i, j] = (v[i, j] - (out[i, :j] * out[j, :j]).sum()) / out[j, j]
    return out


def brute_mcd(base, subsets):
    """Centre, factor, scale and spread of one group; ``subsets`` are the rows of its further starts."""
    centre = np.array([quantile(c, 0.5) for c in base.T])
    spread = np.array([1.4826 * quantile(abs(c - m), 0.5) for c, m in zip(base.T, centre)])
    starts = [(centre, factor_of(np.diag(spread**2)))]
    starts += [(base[k].mean(axis=0), factor_of(np.cov(base[k].T, ddof=0))) for k in subsets if len(k)]
    distance = lambda m, l: (np.linalg.solve(l, (base - m).T) ** 2).sum(axis=0)  # noqa: E731, E741

    def step(m, l):  # noqa: E741
        d2 = distance(m, l)
        kept = base[d2 <= quantile(d2, Q.SUPPORT)]
        return kept.mean(axis=0), factor_of(np.cov(kept.T, ddof=0))

    det = lambda e: 2 * np.log(np.diag(e[1])).sum()
    for _ in range(Q.FIRST_STEPS):
        starts = [step(*e) for e in starts]
    now = min(starts, key=det)
    for _ in range(Q.MAX_STEPS):
        new = step(*now)
        if not det(new) < det(now) - Q.SETTLED:
            break
        now = new
    d2 = distance(*now)
    scale = max(quantile(d2, 0.5) / Q.CHI2_MEDIAN, 1e-3)
    low, high = math.cbrt(Q.CHI2_MEDIAN), math.cbrt(Q.CHI2_QUARTILE)
    return *now, scale, max(1.0, (math.cbrt(quantile(d2, 0.75) / scale) - low) / (high - low))


def subsets_of(spark, base):
    """Rows of the starts that are chosen by hash."""
    names = ", ".join(Q.FEATURES)
    data = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(base)], ", ".join(["i int", *(f"{f} double" for f in Q.FEATURES)]))
    return [
        [r.i for r in data.where(f"pmod(xxhash64({k}, {names}), {math.ceil(len(base) / Q.SUBSET)}) = 0").orderBy("i").collect()]
        for k in range(1, Q.STARTS)
    ]


def test_estimates_equal_numpy(spark):
    rnd = np.random.default_rng(1)
    base = rnd.normal(size=(600, 5)) @ np.diag([1, 0.5, 2, 1, 0.4]) + 40
    base[:60] += 30
    rows = [(*map(float, r), 7) for r in base]
    data = materialise(spark.createDataFrame(rows, ", ".join(f"{f} double" for f in Q.FEATURES) + ", key long"), "t")
    got = Q.mcd_estimates(data).first()
    centre, factor, scale, spread = brute_mcd(base, subsets_of(spark, base))
    assert np.allclose([got[f"m_{i}"] for i in range(5)], centre)
    assert np.allclose([[got[f"l_{i}_{j}"] if j <= i else 0 for j in range(5)] for i in range(5)], factor)
    assert math.isclose(got.scale, scale) and math.isclose(got.spread, spread)
    d2 = (np.linalg.solve(factor, (base - centre).T) ** 2).sum(axis=0)
    assert (d2[:60] / scale > Q.CUTOFF).all()


def test_a_bad_start_is_left_for_one_of_less_determinant(spark):
    """Medians alone see nothing odd in two crossed clouds; a start from a subset finds the tighter one."""
    rnd = np.random.default_rng(5)
    line = rnd.normal(size=(400, 1)) * 4
    tight = np.hstack([line, line, line, rnd.normal(size=(400, 2))]) + rnd.normal(size=(400, 5)) * 0.3
    base = np.vstack([tight, rnd.normal(size=(130, 5)) * 4]) + 50
    data = materialise(spark.createDataFrame([(*map(float, r), 7) for r in base], ", ".join(f"{f} double" for f in Q.FEATURES) + ", key long"), "t")
    dets = {n: Q.mcd_estimates(data, n).first().log_det for n in (1, Q.STARTS)}
    assert dets[Q.STARTS] <= dets[1] + 1e-9


def brute_query(spark, rows):
    """doc_id and kept, group by group, with the fallbacks."""
    base = [brute_base(t) for _, t, *_ in rows]
    lines = [len([x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]) for _, t, *_ in rows]
    vector = lambda b, n: (math.log(b[0]), b[1] / b[0], math.log(1 + 100 * b[2] / b[1]), b[3] / n, b[4] / b[0])
    vectors = {i: np.array(vector(b, n)) for i, (b, n) in enumerate(zip(base, lines, strict=True)) if not b[5]}
    made, out = {}, []
    for i, (doc, _, lang, source) in enumerate(rows):
        if i not in vectors:
            out.append((doc, False))
            continue
        for key in ((lang, source), (lang,), ()):
            members = [j for j in vectors if rows[j][2 : 2 + len(key)] == key]
            if len(members) >= Q.MIN_GROUP or key == ():
                break
        if key not in made:
            group = np.array([vectors[j] for j in members])
            made[key] = brute_mcd(group, subsets_of(spark, group))
        centre, factor, scale, spread = made[key]
        d2 = (np.linalg.solve(factor, vectors[i] - centre) ** 2).sum()
        low = math.cbrt(Q.CHI2_MEDIAN)
        out.append((doc, (low + (math.cbrt(d2 / scale) - low) / spread) ** 3 <= Q.CUTOFF))
    return Counter(out), made


def test_the_whole_query_equals_brute_force(spark):
    rows, junk, short = planted(460)
    more = [(5000 + i, t, "fr" if i % 2 else None, "hot" if i % 5 else None) for i, (_, t, *_) in enumerate(rows[:250])]
    few = [(6000 + i, t, "de", "hot") for i, (_, t, *_) in enumerate(rows[:30])]
    given = [*rows, *junk, *short, *more, *few, rows[0], (None, rows[1][1], "en", "hot")]
    want, made = brute_query(spark, given)
    assert {len(k) for k in made} == {0, 1, 2}  # both fallbacks are met
    assert Counter((r.doc_id, r.kept) for r in Q.quality_rules(frame(spark, given)).collect()) == want


def test_quantiles_do_not_depend_on_partitions(spark):
    rnd = random.Random(9)
    rows = [(i % 3, abs(rnd.gauss(0, 1)) * 10 ** rnd.randrange(-4, 4)) for i in range(900)] + [(7, 0.0)]
    df = spark.createDataFrame(rows, "key int, v double")
    got = [sorted(Q.quantiles(d, ["key"], {"x": "v"}, (0.5, 0.75)).collect()) for d in (df.coalesce(1), df.repartition(7))]
    assert got[0] == got[1] and [r.key for r in got[0]] == [0, 1, 2, 7]
    for r in got[0]:
        x = np.array([v for k, v in rows if k == r.key])
        assert r.x == [quantile(x, 0.5), quantile(x, 0.75)]


def planted(n=400):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9))) for _ in range(3000)]
    prose = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randrange(60, 600)))
    rows = [(i, prose(), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(n)]
    junk = [(n + i, " ".join(w + "&&&" for w in prose().split()), "en", "hot") for i in range(20)]
    short = [(n + 100, "too short", "en", "hot"), (n + 101, None, None, None), (n + 102, "", "fr", "s1")]
    return rows, junk, short


def test_outliers_go_and_prose_stays(spark):
    rows, junk, short = planted()
    got = {r.doc_id: r for r in Q.quality_rules(frame(spark, rows + junk + short)).collect()}
    assert all(got[r[0]].kept for r in rows)
    assert not any(got[r[0]].kept for r in junk + short)
    assert all(got[r[0]].base_failed for r in short) and not any(got[r[0]].base_failed for r in junk)


def test_words_parted_by_pipes_go_and_one_repeated_line_stays(spark):
    rows, junk, _ = planted()
    pipes = [(2000 + i, re.sub(r"(\S+ \S+) ", r"\1 | ", r[1]), "en", "hot") for i, r in enumerate(rows[:30])]
    line = lambda t, n: " ".join(t.split()[:n])
    repeat = [(3000 + i, f"{line(r[1], 9)}\n{line(r[1], 60)}\n{line(r[1], 9)}", "en", "hot") for i, r in enumerate(rows[:6])]
    got = {r.doc_id: r for r in Q.quality_rules(frame(spark, rows + junk + pipes + repeat)).collect()}
    assert all(got[r[0]].n_dup_lines == 1 for r in repeat)
    assert all(got[r[0]].kept for r in rows + repeat)
    assert not any(got[r[0]].kept or got[r[0]].base_failed for r in pipes)


def test_filter_keeps_rows_as_they_are(spark):
    rows, junk, short = planted(60)
    docs = frame(spark, rows + rows[:2] + junk[:5] + short)
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in rows + rows[:2])


def test_empty_table(spark):
    assert Q.quality_rules(frame(spark, [])).collect() == [] and Q.keep_good(frame(spark, [])).collect() == []
