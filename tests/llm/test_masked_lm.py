import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from brindle.llm import masked_lm as M

DOCS = "doc_id long, text string, n_tokens string, word int, key long, rid int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", 1, 2, 3) for r in rows], DOCS)


def grammar(n, seed):
    """Texts in which the middle of three words follows from both its neighbours."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        words = []
        for _ in range(rnd.randrange(5, 40)):
            a, b = rnd.randrange(4), rnd.randrange(4)
            words += [f"l{a}", f"m{(a + b) % 4}", f"r{b}"]
        out.append(" ".join(words).title())
    return out


def split(text):
    return (text or "").encode().lower().split()


def brute_score(text, counts, vocabulary, network):
    """A position at a time, straight from the formula, with the counts of all words."""
    known = {w.encode(): i for i, w in enumerate(vocabulary.words)}
    n_inputs, n_own = vocabulary.n_inputs, vocabulary.n_own

    def place(w):
        rank, ending = known.get(w, 1 << 60), zlib.crc32(w[-3:])
        return (1 + rank if rank < n_inputs else 1 + n_inputs + ending % M.INPUT_ENDINGS), (rank if rank < n_own else n_own + ending % M.ENDINGS)

    members = Counter()
    for w, n in counts.items():
        members[place(w)[1]] += n
    words = split(text)
    inputs = [0] * M.REACH + [place(w)[0] for w in words] + [0] * M.REACH
    p, total = network.p, 0.0
    for i, w in enumerate(words):
        around = inputs[i : i + M.REACH] + inputs[i + M.REACH + 1 : i + 2 * M.REACH + 1]
        h = np.tanh(sum(p["e"][k * vocabulary.inputs + x] for k, x in enumerate(around)) + p["a"])
        z = (h @ p["u"] + p["c"]).astype(np.float64)
        c = place(w)[1]
        total += z[c] - math.log(np.exp(z).sum())
        if c >= n_own:
            total += math.log(counts.get(w, 1) / (members[c] + 1))
    return len(words), total


def test_words_are_those_of_bytes_split():
    texts = ["", None, " ", "\x1c a\x0bB\x0c c\t\n", "É é ÀÉ", "x", " ".join("ab" * 3), " a b"]
    coded, sizes = M.words_of(pa.array(texts, pa.string()))
    words = [w.encode() for w in coded.to_pylist()]
    want = [split(t) for t in texts]
    assert sizes.tolist() == list(map(len, want)) and words == [w for ws in want for w in ws]


def test_counts_and_vocabulary_cover_the_corpus(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = Counter(w.decode() for r in docs.collect() for w in split(r.text))
    counts = M.word_counts(docs)
    assert {r.word: r.n for r in counts.collect()} == words
    vocabulary = M.build_vocabulary(counts, known=3000)
    n = len(vocabulary.words)
    assert 0 < n <= 3000 and vocabulary.words == sorted(words, key=lambda w: (-words[w], w))[:n]
    assert vocabulary.totals.sum() == words.total()
    assert [vocabulary.totals[i] for i in range(5)] == [words[w] for w in vocabulary.words[:5]]


@pytest.mark.parametrize("common", [0, 3, 10])
def test_words_of_like_counts_fill_the_inputs_when_not_all_can_be_known(spark, common):
    words = {f"c{i}": 100 - i for i in range(common)} | {f"w{i:02}": 7 for i in range(40)} | {f"x{i:02}": 1 for i in range(40)}
    counts = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    vocabulary = M.build_vocabulary(counts, known=30, n_own=4, n_inputs=10)
    assert vocabulary.words == sorted(words, key=lambda w: (-words[w], w))[:10]
    assert vocabulary.totals.sum() == sum(words.values()) and vocabulary.totals[3] == words[vocabulary.words[3]]


def test_a_class_and_its_unknown_word_sum_to_one(spark):
    words = Counter({f"w{i}x{j}": 1 + i * j for i in range(9) for j in range(9)})
    counts = spark.createDataFrame(list(words.items()), "word string, n long")
    vocabulary = M.build_vocabulary(counts, known=30, n_own=4, n_inputs=10)
    inputs, classes, ranks = M.Reader(vocabulary).look_up(pa.array(list(words)))
    shares = M.Reader(vocabulary).log_shares(classes, ranks)
    for c in set(classes.tolist()):
        inside = [math.exp(s) * (n if r < 0 else 1) for s, k, r, n in zip(shares, classes, ranks, words.values(), strict=True) if k == c]
        rest = 0 if c < 4 else 1 / (vocabulary.totals[c] + 1)
        assert math.isclose(sum(inside) + rest, 1)


def test_gradient_is_that_of_the_loss():
    rnd = np.random.default_rng(1)
    network = M.WindowNetwork(6, 5, 3)
    network.p = {k: rnd.normal(0, 1, x.shape) for k, x in network.p.items()}
    context, target = rnd.integers(0, 6, (7, 4)), rnd.integers(0, 5, 7)
    g, rows = network.gradient(context, target)

    def loss():
        return -sum(float(math.log(z[t] / s)) for _, _, zs, ss in [network._forward(context)] for z, s, t in zip(zs, ss, target, strict=True)) / 7

    assert sorted(rows.tolist()) == sorted(set((context + network.shift).ravel().tolist()))
    for k, x in network.p.items():
        at = (rows[2], 1) if k == "e" else tuple(rnd.integers(0, s) for s in x.shape)
        x[at] += 1e-5
        up = loss()
        x[at] -= 2e-5
        down = loss()
        x[at] += 1e-5
        assert math.isclose((up - down) / 2e-5, g[k][(2, 1) if k == "e" else at], rel_tol=1e-3, abs_tol=1e-6)


@pytest.fixture(scope="module")
def trained(spark):
    docs = frame(spark, list(enumerate(grammar(300, 1))))
    counts = M.word_counts(docs)
    return (counts, *M.train(docs, counts, rounds=20))


def test_scores_equal_brute_force_and_beat_words_alone_on_held_out_texts(spark, trained):
    counts, vocabulary, network = trained
    words = {r.word.encode(): r.n for r in counts.collect()}
    held = grammar(40, 2)
    rnd = random.Random(3)
    shuffled = [" ".join(rnd.sample(t.split(), len(t.split()))) for t in held]
    edges = [None, "", " \n", "one", "L0 M1 R1 " * 5000, "m0 never seen m0"]
    rows = list(enumerate(held + shuffled + edges)) + [(3, held[3]), (None, held[4])]
    got = M.score(frame(spark, rows), vocabulary, network, counts).collect()
    digits = lambda n: 2 if n < 1000 else -1
    want = Counter((d, n, round(s, digits(n))) for d, t in rows for n, s in [brute_score(t, words, vocabulary, network)])
    assert Counter((r.doc_id, r.n_tokens, round(r.pseudo_log_likelihood, digits(r.n_tokens))) for r in got) == want
    assert all((r.mean_log_likelihood is None) == (r.n_tokens == 0) for r in got)
    score = {r.doc_id: r.mean_log_likelihood for r in got}
    unigram = Counter(w for t in grammar(300, 1) for w in t.lower().split())
    alone = np.mean([math.log(unigram[w] / unigram.total()) for t in held for w in t.lower().split()])
    assert np.mean([score[i] for i in range(40)]) > alone / 2
    assert all(score[i] > score[40 + i] for i in range(40))


def test_both_words_of_a_side_matter(spark):
    """The middle of five words follows from the outer two alone."""
    rnd = random.Random(8)

    def text():
        ws = []
        for _ in range(8):
            a, b = rnd.randrange(3), rnd.randrange(3)
            ws += [f"a{a}", "x", f"m{(a + b) % 3}", "y", f"b{b}"]
        return " ".join(ws)

    docs = frame(spark, [(i, text()) for i in range(200)])
    counts = M.word_counts(docs)
    vocabulary, network = M.train(docs, counts, rounds=20)
    right, wrong = "a1 x m2 y b1", "a1 x m0 y b1"
    got = {r.doc_id: r.pseudo_log_likelihood for r in M.score(frame(spark, [(0, right), (1, wrong)]), vocabulary, network, counts).collect()}
    assert got[0] > got[1] + 2


def test_one_round_beats_no_training_on_real_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = M.word_counts(docs)
    mean = lambda rounds: M.score(docs, *M.train(docs, counts, rounds), counts).agg({"pseudo_log_likelihood": "sum"}).first()[0]
    assert mean(1) > mean(0) + 0.1 * docs.selectExpr("sum(size(split(text, ' ')))").first()[0]


def test_the_same_partitions_give_the_same_network(spark):
    docs = frame(spark, list(enumerate(grammar(60, 5)))).repartition(5, "doc_id").persist()
    counts = M.word_counts(docs)
    a, b = (M.train(docs, counts)[1] for _ in range(2))
    assert all((a.p[k] == b.p[k]).all() for k in a.p)
    assert (a.p["e"] != M.WindowNetwork.of(M.build_vocabulary(counts)).p["e"]).any()


def test_empty_table(spark):
    assert M.score_corpus(frame(spark, [])).collect() == []
    assert [tuple(r) for r in M.score_corpus(frame(spark, [(1, None)])).collect()] == [(1, 0, 0.0, None)]


def test_rare_words_of_one_class_differ(spark):
    texts = [f"{t} {' '.join(f'w{i}x{j}ing' for j in range(20))} oftenxing" for i, t in enumerate(grammar(60, 7))]
    docs = frame(spark, list(enumerate(texts)) + [(0, texts[0]), (None, None)])
    counts = M.word_counts(docs)
    words = {r.word.encode(): r.n for r in counts.collect()}
    vocabulary, network = M.train(docs, counts, known=12, n_own=3, n_inputs=5)  # common words are neither known nor classes
    extra = [(500, "l1 oftenxing r1"), (501, "l1 w3x4ing r1"), (502, "l1 neverxing r1")]
    rows = [tuple(r[:2]) for r in docs.collect()] + extra
    got = M.score(frame(spark, rows), vocabulary, network, counts).collect()
    want = Counter((d, round(brute_score(t, words, vocabulary, network)[1], 1)) for d, t in rows)
    assert Counter((r.doc_id, round(r.pseudo_log_likelihood, 1)) for r in got) == want
    score = {r.doc_id: r.pseudo_log_likelihood for r in got}
    assert score[500] > score[501] + 3 and math.isclose(score[501], score[502], abs_tol=1e-6)
