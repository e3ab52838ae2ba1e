"""Byte-level BPE on a sentencepiece model that is serialised directly from a rank vocabulary.

Every byte is written as one printable character, so a vocabulary entry becomes a piece; its score is
its negative rank and its id is its rank, and the normaliser is the identity. The model's merges then
go by the best score, leftmost first: the merges of the rank file. Texts are cut into pre-tokens by
the vocabulary's pattern and each is encoded for itself; a pre-token that is itself in the vocabulary
is that one id, as in the rank file's own library. Decoding maps ids to pieces and pieces to bytes.

A task keeps what it has encoded, by the space-separated word, in a dictionary of at most ``CACHE`` words and
``CACHE_BYTES`` bytes and gives the memory back at its end; a text whose white space is other than single spaces
goes through the pattern as a whole. Batches are worked on in slices of about ``SLICE`` bytes of text, and
``round_trip`` makes the digests in the worker: neither the text nor the decoded bytes go back.

Defined results: a null or empty text has no ids and decodes to no bytes. Repeated rows stay; every
other column is carried along unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import in_batches, release_memory

CACHE = 250_000
CACHE_BYTES = 24_000_000
SLICE = 2_000_000
_ONE = struct.Struct("<I")
#: No white space next to white space or at an end: then each space begins a pre-token, whatever stands before it.
_PLAIN = re.compile(r"\S+(?:\s\S+)*")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | bytes) -> bytes:
    """A protobuf field: a varint, or bytes with their length."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def byte_characters() -> list[str]:
    """A printable character for each byte, none of them white space or with a meaning of its own."""
    return [chr(0x100 + b) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line has base64 of the token's bytes and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """The ModelProto: pieces in order of rank (so id = rank), then the unknown piece that a model must have."""
    chars = byte_characters()
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    out = []
    for token, rank in by_rank:
        piece = "".join(chars[b] for b in token).encode()
        score = np.float32(-rank).tobytes()
        out.append(_field(1, _field(1, piece) + _varint(2 << 3 | 5) + score + _field(3, 1)))  # NORMAL
    out.append(_field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + np.float32(0).tobytes() + _field(3, 2)))  # UNKNOWN
    trainer = _field(3, 2) + _field(4, len(by_rank) + 1) + _field(40, len(by_rank))  # BPE, vocab_size, unk_id
    trainer += b"".join(_varint(n << 3) + b"\xff" * 9 + b"\x01" for n in (41, 42, 43))  # no bos, eos, pad
    identity = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, identity)


class ByteBpe:
    """Encoder and decoder of one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.ranks))
        self.split = regex.compile(pattern).findall
        self.table = {b: c for b, c in enumerate(byte_characters())}
        back = {c: b for b, c in self.table.items()}
        self.bytes_of = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(self.ranks))]
        self.pieces: pa.Array | None = None
        self.cache: dict[str, bytes] = {}
        self.cached = 0

    def forget(self) -> None:
        self.cache.clear()
        self.cached = 0

    def _encode_words(self, words: list[str]) -> None:
        """Puts the ids of each word, as little-endian 32-bit integers, into the cache."""
        pre = [self.split(w) for w in words]
        coded: dict[str, bytes] = dict.fromkeys(t for ts in pre for t in ts)
        todo = []
        for token in coded:
            raw = token.encode()
            rank = self.ranks.get(raw)
            if rank is None:
                todo.append((token, raw))
            else:
                coded[token] = _ONE.pack(rank)
        written = self.model.encode([raw.decode("latin-1").translate(self.table) for _, raw in todo], num_threads=1)
        for (token, _), ids in zip(todo, written, strict=True):
            coded[token] = struct.pack(f"<{len(ids)}I", *ids)
        for word, tokens in zip(words, pre, strict=True):
            raw = self.cache[word] = coded[tokens[0]] if len(tokens) == 1 else b"".join([coded[t] for t in tokens])
            self.cached += len(word) + len(raw)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        out = []
        for at in range(0, len(texts), 64):
            part = list(map(self._parts, texts[at : at + 64]))
            new = set().union(*part).difference(self.cache)
            if len(self.cache) + len(new) > CACHE or self.cached > CACHE_BYTES:
                self.forget()
                new = set().union(*part)
            self._encode_words(list(new))
            out += [b"".join(map(self.cache.__getitem__, words)) for words in part]
        return out

    def encode_lists(self, texts: pa.StringArray) -> pa.ListArray:
        """The ids of each text as lists of 32-bit integers."""
        raw = self.encode_batch(texts.to_pylist())
        offsets = np.cumsum([0, *(len(x) // 4 for x in raw)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), "<i4")))

    def _parts(self, text: str | None) -> list[str]:
        """Words with the space before them, or pre-tokens: what can be encoded by itself."""
        if not text:
            return []
        if _PLAIN.fullmatch(text):
            head, *rest = text.split(" ")
            return [head, *[" " + w for w in rest]]
        return self.split(text)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_lists(self, lists: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids; a null list gives none."""
        if self.pieces is None:
            self.pieces = pa.array(self.bytes_of, pa.binary())
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        flat = pa.concat_arrays([self.pieces.take(lists.flatten())])
        if not len(flat):
            return pa.array([b""] * len(lists), pa.binary())
        starts = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1]
        offsets = pa.py_buffer(np.ascontiguousarray(starts[ends]))
        return pa.Array.from_buffers(pa.binary(), len(lists), [None, offsets, flat.buffers()[2]])


@functools.lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str) -> ByteBpe:
    """One per worker process."""
    return ByteBpe(path, pattern)


def encode(
    docs: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "ids", decoded_col: str | None = None
) -> DataFrame:
    """``docs`` with ``out_col``: the ids of the text (array of int); and with ``decoded_col``, if named: what the
    ids decode to (binary), in the same worker."""
    at = docs.columns.index(text_col)
    added = [out_col] if decoded_col is None else [out_col, decoded_col]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for whole in it:
            for batch in _slices(whole, at):
                lists = bpe.encode_lists(batch.column(at))
                made = [lists] if decoded_col is None else [lists, bpe.decode_lists(lists)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *added])
        bpe.forget()
        release_memory()

    kinds = [T.ArrayType(T.IntegerType()), T.BinaryType()]
    more = [T.StructField(n, k) for n, k in zip(added, kinds, strict=False)]
    schema = T.StructType([*docs.schema.fields, *more])
    return in_batches(docs, batches, schema)


def decode(rows: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with ``out_col``: the bytes that the ids stand for (binary)."""
    at = rows.columns.index(ids_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in it:
            found = bpe.decode_lists(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, out_col])
        release_memory()

    schema = T.StructType([*rows.schema.fields, T.StructField(out_col, T.BinaryType())])
    return in_batches(rows, batches, schema)


def _slices(batch: pa.RecordBatch, at: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each, at least one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)


def _hex_digests(values: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(v.as_buffer() or b"").hexdigest() for v in values], pa.string())


def round_trip(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, and the ids if asked for."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for whole in it:
            for batch in _slices(whole, 1):
                lists = bpe.encode_lists(batch.column(1))
                written = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, lists.values.cast(pa.string())), ",")
                columns = [batch.column(0), pc.list_value_length(lists).cast(pa.int64()), _hex_digests(written), _hex_digests(bpe.decode_lists(lists))]
                yield pa.RecordBatch.from_arrays([*columns, *([lists] if with_ids else [])], names=schema.names)
        bpe.forget()
        release_memory()

    picked = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    made = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    schema = T.StructType([picked.schema["doc_id"], *T._parse_datatype_string(made).fields])
    return in_batches(picked, batches, schema)
