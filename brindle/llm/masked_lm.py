"""Masked pseudo-likelihood scores from a bidirectional window network, trained in numpy.

Every word (lower-cased, parted by white space) is predicted from the ``REACH`` words on each of its sides:

    h = tanh(sum over d in (-2, -1, 1, 2) of E[d, word at d] + a),   p(class) = softmax(h U + c)
    log p(word) = log p(class | both sides) + log p(word | class)

A document's score is the sum over its words: its masked pseudo-log-likelihood. On the input side the
``N_INPUTS`` most frequent words have vectors of their own, others share one by their ending, and input 0 stands
beyond the borders of a text. On the output side the ``N_OWN`` most frequent words are classes of their own and all
others fall into classes by their ending, in which the corpus's counts decide: of a class with N words,
p(word | class) = n / (N + 1), and what is left is for words the corpus doesn't have. So all words of the corpus
and one unknown of each class share a probability of one in every context.

All documents count, at any size. Word counts are a table that grows with the vocabulary of the corpus and is
never collected: the most frequent words (``KNOWN`` at most, about 1 MB) go to the workers, and the others of
each document are joined with the table. Training streams over the windows of all documents once a round: every
task starts from the same weights, takes Adagrad steps on its own windows and gives its weights (1 MB) back; they
are averaged by numbers of words in pieces, so what the driver gets is one set of weights. The same table in the
same partitions gives the same network.

Defined results: a null text or one without words has n_tokens 0, score 0.0 and a null mean; repeated
rows are scored each; an empty table trains nothing and gives an empty result; null ids stay; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import in_batches, materialise, release_memory

KNOWN = 100_000
N_INPUTS = 3967
INPUT_ENDINGS = 128
N_OWN = 32
ENDINGS = 32
REACH = 2
HIDDEN = 16
STEP_WINDOWS = 512
RATE = 0.2
ROUNDS = 1
SEED = 11
_FLUSH = 300_000
_PIECE = 4096  # weights a row


@dataclass
class Vocabulary:
    """The known words by falling count, with their counts, and the number of words in each class."""

    words: list[str]
    counts: np.ndarray
    totals: np.ndarray
    n_own: int = N_OWN
    n_inputs: int = N_INPUTS

    @property
    def classes(self) -> int:
        return self.n_own + ENDINGS

    @property
    def inputs(self) -> int:
        return 1 + self.n_inputs + INPUT_ENDINGS


class Reader:
    """Input, class and rank of words; a batch's distinct words are looked up once each."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        self.words = pa.array(v.words, pa.string())
        ranks = np.arange(len(v.words))
        endings = self._endings(self.words)
        self.inputs = np.where(ranks < v.n_inputs, 1 + ranks, 1 + v.n_inputs + endings % INPUT_ENDINGS)
        self.classes = np.where(ranks < v.n_own, ranks, v.n_own + endings % ENDINGS)

    def _endings(self, words: pa.Array) -> np.ndarray:
        """A hash of the last three bytes of each word."""
        coded = pc.binary_slice(words.cast(pa.binary()), -3, None).dictionary_encode()
        hashes = np.array([zlib.crc32(x) for x in coded.dictionary.to_pylist()], np.int64)
        return hashes[coded.indices.to_numpy()]

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input, class and rank (-1: not known) of each."""
        v = self.vocabulary
        ranks = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        odd = np.flatnonzero(ranks < 0)
        inputs, classes = np.empty(ranks.size, np.int32), np.empty(ranks.size, np.int32)
        there = ranks >= 0
        inputs[there], classes[there] = self.inputs[ranks[there]], self.classes[ranks[there]]
        endings = self._endings(words.take(pa.array(odd)))
        inputs[odd], classes[odd] = 1 + v.n_inputs + endings % INPUT_ENDINGS, v.n_own + endings % ENDINGS
        return inputs, classes, ranks

    def log_shares(self, classes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """log p(word | class); for words that aren't known, of a word that the corpus has once (or never)."""
        v = self.vocabulary
        out = -np.log(v.totals[classes] + 1.0)
        out[ranks >= 0] += np.log(v.counts[ranks[ranks >= 0]])
        out[(ranks >= 0) & (ranks < v.n_own)] = 0.0
        return out


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of the texts one after another, coded by distinct words, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), ""))))
    flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    there = pc.not_equal(flat, "")
    if not pc.all(there).as_py():  # texts without words give one empty word each
        owner = np.repeat(np.arange(sizes.size), sizes)[there.to_numpy(zero_copy_only=False)]
        flat, sizes = flat.filter(there), np.bincount(owner, minlength=sizes.size)
    return flat.dictionary_encode(), sizes


def windows(ids: np.ndarray, sizes: np.ndarray, reach: int = REACH) -> np.ndarray:
    """(positions, 2 * reach) inputs around every position; beyond the borders of a text stands input 0."""
    at = np.arange(ids.size) + reach * (np.repeat(np.arange(sizes.size), sizes) + 1)
    padded = np.zeros(ids.size + reach * (sizes.size + 1), np.int32)
    padded[at] = ids
    return np.stack([padded[at + d] for d in (*range(-reach, 0), *range(1, reach + 1))], axis=1)


def _texts(docs: DataFrame, *more) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"), *more)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents; counts are summed in each task before they are shuffled."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in it:
            coded, _ = words_of(batch.column(0))
            n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
            held.append(pa.table({"word": coded.dictionary, "n": pa.array(n, pa.int64())}))
            rows += len(coded.dictionary)
            if rows > _FLUSH:
                held, rows = [summed(held)], 0
                if held[0].num_rows > _FLUSH // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from summed(held).to_batches()
        release_memory()

    def summed(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).combine_chunks()

    return in_batches(_texts(docs), batches, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_vocabulary(counts: DataFrame, known: int = KNOWN, n_own: int = N_OWN, n_inputs: int = N_INPUTS) -> Vocabulary:
    """The most frequent words, as many whole classes of like counts as ``known`` allows, and the class totals.

    Where the next class of counts is too large, its first words, by count and then by name, still fill up the inputs and classes of their own.
    """
    level = F.floor(F.ln("n") * 64).cast("int")
    by_level = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect()  # 64 * 44 rows at most
    least, room, left_out = None, known, None
    for r in by_level:
        if r.words > room:
            left_out = r.level
            break
        least, room = r.level, room - r.words
    found = counts.where(level >= least) if least is not None else counts.limit(0)
    found, short = found.select("word", "n"), min(known, max(n_own, n_inputs)) - (known - room)
    if left_out is not None and short > 0:
        found = found.union(counts.where(level == left_out).select("word", "n").orderBy(F.desc("n"), "word").limit(short))
    found = found.toArrow()
    pairs = sorted(zip(found["word"].to_pylist(), found["n"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    vocabulary = Vocabulary([w for w, _ in pairs], np.array([n for _, n in pairs], np.float64), np.zeros(n_own + ENDINGS), n_own, n_inputs)
    vocabulary.totals = _class_totals(counts, vocabulary)
    return vocabulary


def _class_totals(counts: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Words of the corpus by class."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, totals = Reader(vocabulary), np.zeros(vocabulary.classes, np.int64)
        for batch in it:
            _, classes, _ = reader.look_up(batch.column(0))
            np.add.at(totals, classes, batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(totals.size)), pa.array(totals)], names=["class", "n"])

    out = np.zeros(vocabulary.classes)
    for r in in_batches(counts.select("word", "n"), batches, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        out[r["class"]] = r.n
    return out


class WindowNetwork:
    """The network, its gradient and Adagrad steps; everything is float32 numpy."""

    def __init__(self, inputs: int, classes: int, hidden: int = HIDDEN, reach: int = REACH, seed: int = SEED):
        rnd = np.random.default_rng(seed)
        shape = {"e": (2 * reach * inputs, hidden), "a": (hidden,), "u": (hidden, classes), "c": (classes,)}
        self.p = {k: rnd.normal(0, 0.1, s).astype(np.float32) for k, s in shape.items()}
        self.shift = (np.arange(2 * reach) * inputs).astype(np.int32)
        self.squares: dict[str, np.ndarray] | None = None

    @classmethod
    def of(cls, vocabulary: Vocabulary) -> WindowNetwork:
        """Before training: small random weights, and the classes' shares in the corpus."""
        out = cls(vocabulary.inputs, vocabulary.classes)
        out.p["c"] = np.log((vocabulary.totals + 0.5) / (vocabulary.totals.sum() + 0.5 * vocabulary.classes)).astype(np.float32)
        return out

    def _forward(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows of e, hidden values, and p of all classes as exp(z) over its sum."""
        rows = context + self.shift
        h = self.p["e"][rows[:, 0]]
        for k in range(1, rows.shape[1]):
            h += self.p["e"][rows[:, k]]
        h += self.p["a"]
        np.tanh(h, out=h)
        z = h @ self.p["u"]
        z += self.p["c"]
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        return rows, h, z, z.sum(axis=1)

    def log_probabilities(self, context: np.ndarray, classes: np.ndarray, block: int = 2048) -> np.ndarray:
        """log p(class | context) of every position."""
        out = np.empty(classes.size, np.float32)
        for at in range(0, classes.size, block):
            part = slice(at, at + block)
            _, _, z, total = self._forward(context[part])
            out[part] = np.log(np.maximum(z[np.arange(total.size), classes[part]], 1e-37) / total)
        return out

    def gradient(self, context: np.ndarray, classes: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradient of the mean negative log-likelihood, and the rows of e that the gradient "e" is for."""
        n = classes.size
        rows, h, z, total = self._forward(context)
        z *= (np.float32(1 / n) / total)[:, None]
        z[np.arange(n), classes] -= np.float32(1 / n)
        dh = z @ self.p["u"].T
        dh *= 1 - h * h
        flat = rows.T.ravel()
        order = np.argsort(flat.astype(np.uint16) if self.p["e"].shape[0] <= 1 << 16 else flat, kind="stable")
        flat = flat[order]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        g = {"u": h.T @ z, "c": z.sum(axis=0), "a": dh.sum(axis=0), "e": np.add.reduceat(dh[order % n], first, axis=0)}
        return g, flat[first]

    def step(self, context: np.ndarray, classes: np.ndarray, rate: float = RATE) -> None:
        """One Adagrad step."""
        if self.squares is None:
            self.squares = {k: np.full_like(x, 1e-8) for k, x in self.p.items()}
        g, rows = self.gradient(context, classes)
        for k, x in g.items():
            at = rows if k == "e" else slice(None)
            squares = self.squares[k][at] + x * x
            self.squares[k][at] = squares
            self.p[k][at] -= np.float32(rate) * x / np.sqrt(squares)

    def weights(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def set_weights(self, flat: np.ndarray) -> None:
        start = 0
        for k, x in self.p.items():
            self.p[k] = flat[start : start + x.size].reshape(x.shape).astype(np.float32)
            start += x.size


def train_round(docs: DataFrame, vocabulary: Vocabulary, network: WindowNetwork) -> None:
    """Every task takes steps on all windows of its documents; the network gets the average, by words, of their weights."""
    start = network.weights()

    def steps(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, own = Reader(vocabulary), WindowNetwork.of(vocabulary)
        own.set_weights(start)
        seen, rnd = 0, np.random.default_rng(SEED)
        for batch in it:
            coded, sizes = words_of(batch.column(0))
            inputs, classes, _ = reader.look_up(coded.dictionary)
            ids = coded.indices.to_numpy()
            context, target = windows(inputs[ids], sizes), classes[ids]
            order = rnd.permutation(ids.size)
            for at in range(0, ids.size, STEP_WINDOWS):
                part = order[at : at + STEP_WINDOWS]
                own.step(context[part], target[part])
            seen += ids.size
        if seen:
            flat = own.weights()
            pieces = [flat[at : at + _PIECE].astype("<f4").tobytes() for at in range(0, flat.size, _PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([seen] * len(pieces)), pa.array(pieces)], names=["piece", "n", "weights"])
        release_memory()

    def average(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, sums, done = None, 0, None, []
        for batch in it:
            for piece, n, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if piece != now:
                    if now is not None:
                        done.append((now, (sums / total).astype("<f4").tobytes()))
                    now, total, sums = piece, 0, 0.0
                total, sums = total + n, sums + n * np.frombuffer(raw, "<f4").astype(np.float64)
        if now is not None:
            done.append((now, (sums / total).astype("<f4").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done], pa.binary())], names=["piece", "weights"])

    made = in_batches(_texts(docs), steps, "piece int, n long, weights binary").withColumn("task", F.spark_partition_id())
    dealt = made.repartition("piece").sortWithinPartitions("piece", "task").select("piece", "n", "weights")
    found = in_batches(dealt, average, "piece int, weights binary").toArrow()
    pieces = sorted(zip(found["piece"].to_pylist(), found["weights"].to_pylist(), strict=True))
    if pieces:
        network.set_weights(np.frombuffer(b"".join(raw for _, raw in pieces), "<f4"))


def train(docs: DataFrame, counts: DataFrame, rounds: int = ROUNDS, **sizes: int) -> tuple[Vocabulary, WindowNetwork]:
    """Vocabulary and network from all documents and their word counts."""
    vocabulary = build_vocabulary(counts, **sizes)
    network = WindowNetwork.of(vocabulary)
    for _ in range(rounds):
        train_round(docs, vocabulary, network)
    return vocabulary, network


def score(docs: DataFrame, vocabulary: Vocabulary, network: WindowNetwork, counts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens, pseudo_log_likelihood and mean_log_likelihood of every row."""
    weights = network.weights()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, made = Reader(vocabulary), WindowNetwork.of(vocabulary)
        made.set_weights(weights)
        for batch in it:
            coded, sizes = words_of(batch.column(0))
            inputs, classes, ranks = reader.look_up(coded.dictionary)
            shares, ids = reader.log_shares(classes, ranks), coded.indices.to_numpy()
            logs = made.log_probabilities(windows(inputs[ids], sizes), classes[ids]) + shares[ids]
            ends = np.cumsum(sizes)
            sums = np.diff(np.concatenate([[0.0], np.cumsum(logs, dtype=np.float64)])[np.concatenate([[0], ends])])
            # the words that aren't known, distinct within a text, with how often it has them
            owner = np.repeat(np.arange(sizes.size), sizes)
            odd = np.flatnonzero(ranks[ids] < 0)
            pairs, times = np.unique(owner[odd] * max(1, ranks.size) + ids[odd], return_counts=True)
            of, word = pairs // max(1, ranks.size), pairs % max(1, ranks.size)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=sizes.size))]).astype(np.int32))
            rare = pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(word)))
            often = pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))
            columns = [batch.column(1), batch.column(2), pa.array(sizes), pa.array(sums), rare, often]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        release_memory()

    picked = _texts(docs, F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("rid"))
    made = "rid long, n_tokens long, pseudo_log_likelihood double, rare array<string>, times array<int>"
    schema = T.StructType([picked.schema["id"], *T._parse_datatype_string(made).fields])
    scored = materialise(in_batches(picked, batches, schema), "scored")
    pairs = scored.select("rid", F.inline(F.arrays_zip("rare", "times"))).withColumnRenamed("rare", "word")
    # the logarithm of a count of one is zero, so only words that the corpus has more often are joined
    met = pairs.join(counts.where("n > 1"), "word").groupBy("rid").agg(F.sum(F.col("times") * F.ln("n")).alias("more"))
    total = F.col("pseudo_log_likelihood") + F.coalesce("more", F.lit(0.0))
    scored = scored.drop("rare", "times").join(met, "rid", "left").select(F.col("id").alias(id_col), "n_tokens", total.alias("pseudo_log_likelihood"))
    mean = F.when(F.col("n_tokens") > 0, F.col("pseudo_log_likelihood") / F.col("n_tokens"))
    return scored.withColumn("mean_log_likelihood", mean)


def score_corpus(docs: DataFrame) -> DataFrame:
    """Trains on all documents and scores each."""
    counts = materialise(word_counts(docs), "word-counts")
    vocabulary, network = train(docs, counts)
    return score(docs, vocabulary, network, counts)
