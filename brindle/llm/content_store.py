"""Content-addressed store of token ids.

Each document's ids (its text's, then an end id) are cut into chunks where a rolling hash over the
last ``WINDOW`` ids has a given pattern, between ``MIN_CHUNK`` and ``MAX_CHUNK`` ids; equal passages
so give equal chunks. A chunk's address is the SHA-256 of its bytes (ids as little-endian 16-bit
integers; the vocabulary must fit). A store is a folder with three Parquet datasets:

- ``chunks``: address, n_ids and bytes of every distinct chunk, once, under the hash of its address;
- ``recipes``: doc_id, row, n_ids and the addresses of its chunks, in ascending doc_id order (null
  ids first, equal ids in input order) over numbered parts;
- ``manifest``: per part its rows, ids, the ids of all parts before it, and the Merkle root of its
  documents; the root over the parts' roots stands in every row.

A document's leaf is the SHA-256 of its number of ids and chunk addresses. ``read_store`` reads the
files back: chunk bytes must hash to their address, parts to their Merkle roots, and documents get
their digests from the chunks (CRCs of chunks are combined, so no document is put together to be
checked). ``read_ids`` gives whole id lists.

Encoding runs once; its output is written to the shared folder and feeds both chunks and recipes.
Copies meet in a pre-aggregated groupBy of the address, so a chunk that a third of all documents
share costs one row a task. Defined results: a null or empty text has just the end id; repeated rows
are documents of their own; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window
from tokenizers import Tokenizer, pre_tokenizers

from brindle.llm.common import gathered, in_batches, materialise, release_memory, shared_dir

#: Words of printable ASCII, Latin-1 letters and common marks: composed already, lower-cased one to one.
_PLAIN = "^[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u00a1\u00ab\u00bb\u00bf\u2013\u2014\u2018\u2019\u201c\u201d\u201e\u2026]+$"
#: How the vocabulary's pattern cuts such words after lower-casing.
_PIECES = "('s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^0-9a-z\u00df-\u00f6\u00f8-\u00ff]+)"
#: The normaliser, pre-tokenizer and word mark, as files state them, for which a word's ids are the same in any text.
BY_WORD = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "end_of_word_suffix": "</w>",
}
#: A control character: one byte, one pre-token between spaces, and no part of any other character.
MARK = "\x7f"
WINDOW = 16
MIN_CHUNK = 64
MAX_CHUNK = 1024
MASK_BITS = 8
CACHE = 400_000
#: Text is worked on in parts of this size: the larger, the fewer words are distinct.
SLICE = 24_000_000
ROWS_PER_PART = 200_000


def _grouped(values: pa.LargeBinaryArray, lengths: np.ndarray) -> pa.LargeBinaryArray:
    """Runs of so many values, each put together."""
    at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    if not len(values):
        return pa.array([b""] * len(lengths), pa.large_binary())
    ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(np.ascontiguousarray(ends[at])), values.buffers()[2]])


def _lengths(lists: pa.ListArray) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False)


class WordEncoder:
    """Ids of texts, by the white-space separated word; the vocabulary drops white space between words.

    That holds for files whose normaliser and pattern are ``BY_WORD``; with any other, whole texts go through the library.
    The distinct words of a batch are cut into pre-tokens by Arrow's functions, and each distinct pre-token is
    encoded once, by the library's merges without its slow normaliser and pattern; its last id is one that ends
    a word. The worker's next tasks know them still, up to ``CACHE`` of them. All words that ``_PLAIN`` doesn't fit go through the whole of the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores are busy with other tasks
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        self.pieces: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}
        size = self.model.get_vocab_size()
        if size > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        stated = json.loads(self.model.to_str())
        stated["end_of_word_suffix"] = stated["model"].get("end_of_word_suffix")
        self.by_word = all(stated.get(k) == v for k, v in BY_WORD.items())
        if not self.by_word:
            return
        (self.mark,) = self._ids(MARK).tolist()
        self.merges = Tokenizer(self.model.model)
        self.merges.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.ends_word = np.zeros(size, bool)
        for token, i in self.model.get_vocab(with_added_tokens=False).items():
            self.ends_word[i] = token.endswith("</w>")

    def _known(self, cache: dict[str, bytes], wanted: list[str], learn: Callable[[list[str]], None]) -> pa.LargeBinaryArray:
        new = [w for w in wanted if w not in cache]
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = wanted
        learn(new)
        return pa.array(list(map(cache.__getitem__, wanted)), pa.large_binary())

    def _learn_pieces(self, todo: list[str]) -> None:
        for at in range(0, len(todo), 2000):
            part = todo[at : at + 2000]
            ids = np.array(self.merges.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u2")
            raw, start = ids.tobytes(), 0
            for piece, end in zip(part, (2 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist(), strict=True):
                self.pieces[piece] = raw[start:end]
                start = end

    def _learn_odd(self, words: list[str]) -> None:
        """Encodes words many at a time, parted by a mark that is a pre-token and an id of its own."""
        marked = [w for w in words if MARK in w]
        todo = [w for w in words if MARK not in w]
        for at in range(0, len(todo), 2000):
            part = todo[at : at + 2000]
            ids = self._ids(f" {MARK} ".join(part))
            raw, start = ids.tobytes(), 0
            for word, end in zip(part, [*np.flatnonzero(ids == self.mark).tolist(), ids.size], strict=True):
                self.odd[word] = raw[2 * start : 2 * end]
                start = end + 1
        for word in marked:
            self.odd[word] = self._ids(word).tobytes()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u2")

    def _words(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        """Ids of each distinct word, as little-endian 16-bit integers."""
        fits = pc.match_substring_regex(words, _PLAIN)
        plain, odd = pc.utf8_lower(words.filter(fits)), words.filter(pc.invert(fits))
        cut = pc.ascii_split_whitespace(pc.ascii_rtrim_whitespace(pc.replace_substring_regex(plain, _PIECES, r"\1 ")))
        pieces = cut.flatten().dictionary_encode()
        known = self._known(self.pieces, pieces.dictionary.to_pylist(), self._learn_pieces)
        ids = [_grouped(known.take(pieces.indices), _lengths(cut)), self._known(self.odd, odd.to_pylist(), self._learn_odd)]
        order = np.argsort(~fits.to_numpy(zero_copy_only=False), kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(order.size)
        return pa.concat_arrays(ids).take(pa.array(back))

    def encode_batch(self, texts: pa.StringArray, end_id: int) -> list[bytes]:
        """Little-endian 16-bit ids of each text, closed by ``end_id``."""
        end = end_id.to_bytes(2, "little")
        if not self.by_word:
            return [self._ids(t or "").tobytes() + end for t in texts.to_pylist()]
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        words = split.flatten().dictionary_encode()
        ids = self._words(words.dictionary).take(words.indices)
        return [raw + end for raw in _grouped(ids, _lengths(split)).to_pylist()]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One per worker process."""
    return WordEncoder(path)


@functools.lru_cache(maxsize=1)
def _gear() -> np.ndarray:
    """A fixed random 64-bit value of each id."""
    return np.random.default_rng(20).integers(0, 1 << 64, 1 << 16, dtype=np.uint64)


def cut_points(ids: np.ndarray) -> np.ndarray:
    """Where the chunks of a document end. A cut depends on the WINDOW ids before it and on the last cut."""
    n = ids.size
    if n <= MIN_CHUNK:
        return np.array([n])
    rolled = _gear()[ids]
    reach = 1
    while reach < WINDOW:  # the sum over the last 2, 4, 8, 16 ids, shifted by their distance
        longer = rolled.copy()
        longer[reach:] += rolled[:-reach] << np.uint64(reach)
        rolled, reach = longer, reach * 2
    marks = np.flatnonzero(rolled >> np.uint64(64 - MASK_BITS) == 0) + 1
    cuts, last, k = [], 0, 0
    marks = marks.tolist()
    while n - last > MIN_CHUNK:
        while k < len(marks) and marks[k] - last < MIN_CHUNK:
            k += 1
        end = min(marks[k] if k < len(marks) else n, last + MAX_CHUNK, n)
        cuts.append(end)
        last = end
    if last < n:
        cuts.append(n)
    return np.array(cuts)


_CODED = "row long, n_ids long, addresses array<binary>, new array<int>, pieces array<binary>"
#: A task knows so many addresses (some 25 MB) before it forgets them all.
MET = 200_000


def _code(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Per document its chunks; a task gives a chunk's bytes where it first meets it, ``new`` being its place among the addresses."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, met = encoder(path), set()
        for whole in gathered(it, SLICE):
            for batch in _slices(whole):
                n_ids, addresses, new, pieces = [], [], [], []
                for raw in words.encode_batch(batch.column(2), end_id):
                    ids = np.frombuffer(raw, "<u2")
                    names, places, parts, start = [], [], [], 0
                    for end in cut_points(ids).tolist():
                        piece = raw[2 * start : 2 * end]
                        name = hashlib.sha256(piece).digest()
                        if name not in met:
                            met.add(name)
                            places.append(len(names))
                            parts.append(piece)
                        names.append(name)
                        start = end
                    n_ids.append(ids.size)
                    addresses.append(names)
                    new.append(places)
                    pieces.append(parts)
                    if len(met) > MET:
                        met.clear()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array(n_ids, pa.int64()),
                        pa.array(addresses, pa.list_(pa.binary())),
                        pa.array(new, pa.list_(pa.int32())),
                        pa.array(pieces, pa.list_(pa.binary())),
                    ],
                    names=schema.names,
                )
        release_memory()

    picked = docs.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text")
    )
    schema = T.StructType([picked.schema["doc_id"], *T._parse_datatype_string(_CODED).fields])
    return in_batches(picked, batches, schema)


def _slices(batch: pa.RecordBatch, most: int = SLICE * 3 // 2) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each, at least one row."""
    start, total = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_pylist()):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)


def leaf(n_ids: int, addresses: list[bytes]) -> bytes:
    return hashlib.sha256(n_ids.to_bytes(8, "little") + b"".join(addresses)).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairs are hashed level by level; an odd node moves up; no leaves give the hash of nothing."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    while len(leaves) > 1:
        paired = [hashlib.sha256(a + b).digest() for a, b in zip(leaves[::2], leaves[1::2], strict=False)]
        leaves = paired + leaves[len(leaves) - len(leaves) % 2 :]
    return leaves[0]


_PARTS = "part int, rows long, n_ids long, root binary"


def _part_roots(recipes: DataFrame) -> DataFrame:
    """Rows, ids and Merkle root of each part of the recipes, from rows sorted by (part, position)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, leaves, ids = None, [], 0
        for batch in it:
            for p, n, names in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if p != part and part is not None:
                    yield row(part, leaves, ids)
                    leaves, ids = [], 0
                part = p
                leaves.append(leaf(n, names))
                ids += n
        if part is not None:
            yield row(part, leaves, ids)

    def row(part: int, leaves: list[bytes], ids: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([len(leaves)]), pa.array([ids]), pa.array([merkle_root(leaves)])],
            names=["part", "rows", "n_ids", "root"],
        )

    dealt = recipes.select("part", "n_ids", "addresses", "position").repartition("part").sortWithinPartitions("part", "position")
    return in_batches(dealt, batches, _PARTS)


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, rows_per_part: int = ROWS_PER_PART) -> None:
    """Writes the store of ``docs`` (doc_id, text) under ``path``."""
    spark = docs.sparkSession
    coded = materialise(_code(docs, tokenizer_path, end_id), "coded")
    named = F.transform("new", lambda i: F.get("addresses", i))
    (
        coded.select(F.inline(F.arrays_zip(named.alias("address"), F.col("pieces").alias("bytes"))))
        .groupBy("address")
        .agg(F.first("bytes").alias("bytes"))
        .select("address", (F.octet_length("bytes") / 2).cast("int").alias("n_ids"), "bytes")
        .write.option("compression", "zstd")
        .parquet(f"{path}/chunks")
    )
    # parts are ranges of (doc_id, row); equal ids are told apart by the row, so no id is too common to split
    count = coded.count()
    parts = max(1, -(-count // rows_per_part), min(count, spark.sparkContext.defaultParallelism))
    ordered = (
        coded.select("doc_id", "row", "n_ids", "addresses")
        .repartitionByRange(parts, "doc_id", "row")
        .sortWithinPartitions("doc_id", "row")
        .select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("position"))
    )
    ordered.write.option("compression", "zstd").parquet(f"{path}/recipes")
    found = spark.read.parquet(f"{path}/recipes")
    roots = _part_roots(found).orderBy("part").collect()  # a row for each part
    whole = merkle_root([r.root for r in roots])
    rows, start = [], 0
    for r in roots:
        rows.append((r.part, r.rows, r.n_ids, start, r.root, whole))
        start += r.n_ids
    manifest = "part int, rows long, n_ids long, start long, root binary, store_root binary"
    spark.createDataFrame(rows, manifest).coalesce(1).write.parquet(f"{path}/manifest")


@functools.lru_cache(maxsize=1)
def _crc_shift() -> np.ndarray:
    """[n][byte number][byte]: what n more zero ids (of four bytes) make of a CRC; it is linear."""
    one = np.array([[(b << 8 * k) for b in range(256)] for k in range(4)], np.uint32)
    table = np.array([_zero_byte_step(i) for i in range(256)], np.uint32)
    shift = np.empty((MAX_CHUNK + 1, 4, 256), np.uint32)
    shift[0] = one
    for n in range(1, MAX_CHUNK + 1):
        crc = shift[n - 1]
        for _ in range(4):
            crc = table[crc & 255] ^ (crc >> np.uint32(8))
        shift[n] = crc
    return shift


def _zero_byte_step(i: int) -> int:
    for _ in range(8):
        i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
    return i


def combine_crc(crcs: list[int], lengths: list[int]) -> int:
    """CRC-32 of what stands after one another: parts of so many 4-byte ids with the CRCs given."""
    shift, crc = _crc_shift(), 0
    for part, n in zip(crcs, lengths, strict=True):
        at = shift[n]
        crc = int(at[0, crc & 255] ^ at[1, crc >> 8 & 255] ^ at[2, crc >> 16 & 255] ^ at[3, crc >> 24]) ^ part
    return crc


def _chunk_digests(chunks: DataFrame) -> DataFrame:
    """address, n and CRC-32 of the chunk's ids as 32-bit integers; bytes that don't hash to the address raise."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sizes, crcs = [], []
            for name, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if hashlib.sha256(piece).digest() != name:
                    raise ValueError(f"chunk {name.hex()} is damaged")
                sizes.append(len(piece) // 2)
                crcs.append(zlib.crc32(np.frombuffer(piece, "<u2").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(crcs, pa.int64())], names=["address", "n", "crc"])

    return in_batches(chunks.select("address", "bytes"), batches, "address binary, n int, crc long")


def verify(spark: SparkSession, path: str) -> None:
    """Raises if the recipes don't have the Merkle roots of the manifest."""
    manifest = spark.read.parquet(f"{path}/manifest").orderBy("part").collect()
    found = _part_roots(spark.read.parquet(f"{path}/recipes")).orderBy("part").collect()
    if [(r.part, r.rows, r.n_ids, r.root) for r in found] != [(r.part, r.rows, r.n_ids, r.root) for r in manifest]:
        raise ValueError("the recipes differ from the manifest")
    if manifest and merkle_root([r.root for r in manifest]) != manifest[0].store_root:
        raise ValueError("the manifest's roots differ from the store's")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files; a missing or damaged chunk raises."""
    verify(spark, path)
    recipes = spark.read.parquet(f"{path}/recipes")
    digests = _chunk_digests(spark.read.parquet(f"{path}/chunks"))
    used = recipes.select("part", "position", F.posexplode("addresses").alias("k", "address"))
    met = used.join(digests, "address", "left")
    per_doc = met.groupBy("part", "position").agg(
        F.array_sort(F.collect_list(F.struct("k", "n", "crc"))).alias("chunks"), F.count("n").alias("found"), F.count("*").alias("wanted")
    )

    @F.pandas_udf("long")
    def crc(chunks):
        return chunks.map(lambda x: combine_crc([int(c["crc"]) for c in x], [int(c["n"]) for c in x]))

    checked = per_doc.select(
        "part",
        "position",
        F.when(F.col("found") == F.col("wanted"), crc("chunks")).otherwise(F.raise_error(F.lit("a chunk is missing"))).alias("ids_crc32"),
    )
    offsets = spark.read.parquet(f"{path}/manifest").select("part", F.col("start").alias("before"))
    running = Window.partitionBy("part").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    placed = recipes.select(
        "doc_id", "part", "position", F.col("n_ids").alias("n_tokens"), F.coalesce(F.sum("n_ids").over(running), F.lit(0)).alias("inside")
    )
    return (
        placed.join(offsets, "part")
        .join(checked, ["part", "position"])
        .select("doc_id", (F.col("before") + F.col("inside")).cast("long").alias("start"), "n_tokens", "ids_crc32")
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids (array of int) of each document, put together from its chunks."""
    recipes = spark.read.parquet(f"{path}/recipes")
    used = recipes.select("doc_id", "row", F.posexplode("addresses").alias("k", "address"))
    whole = (
        used.join(spark.read.parquet(f"{path}/chunks"), "address")
        .groupBy("doc_id", "row")
        .agg(F.array_sort(F.collect_list(F.struct("k", "bytes"))).alias("chunks"))
    )

    @F.pandas_udf("array<int>")
    def join(chunks):
        return chunks.map(lambda x: np.frombuffer(b"".join(c["bytes"] for c in x), "<u2").astype(np.int32))

    return whole.select("doc_id", join("chunks").alias("ids"))


def stored(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Writes a store in the shared folder and reads it back: see read_store."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/store-{uuid.uuid4().hex}"
    write_store(docs.select("doc_id", "text"), path, tokenizer_path, end_id)
    return read_store(spark, path)
