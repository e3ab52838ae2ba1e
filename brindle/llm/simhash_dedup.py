"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. Two fingerprints that differ in at most two
bits have a segment that differs in at most one, so they share a *variant*: that segment with one
bit position wiped out. Every distinct fingerprint is indexed under its 64 variants, equal variants
meet in one bucket, and each bucket is verified by Hamming distance and reduced to a spanning forest
of its true links. Copies collapse to one fingerprint before that, so a group of copies costs one row.

A bucket that outgrows ``bucket_limit`` is cut again by the same rule on its free segment; such a
bucket has 46 fixed bits, so it can hold 2**18 fingerprints (2 MB) at the very most.

Defined results: a null or empty text has fingerprint zero and links like any other. Repeated rows
stay repeated rows. A null ``doc_id`` keeps its row; it never is a component id unless the component
has no other id. An empty table gives an empty result. Columns other than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import in_batches, materialise, numbered, release_memory, without

SEED = 42
MAX_DISTANCE = 2
BUCKET_LIMIT = 8192
_BLOCK = 1 << 15


def simhash(text: bytes | None) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text: majority of the bits of its 3-word shingles' XXH64."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    grams = zip(words, words[1:], words[2:], strict=False) if len(words) >= 3 else [words]
    total = max(1, len(words) - 2)
    digest, join = xxhash.xxh64_digest, b" ".join
    counts = np.zeros(64, np.int64)
    pending: list[bytes] = []
    for gram in grams:
        pending.append(digest(join(gram), SEED))
        if len(pending) == _BLOCK:
            counts += _bit_counts(pending)
            pending = []
    if pending:
        counts += _bit_counts(pending)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def _bit_counts(digests: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fp`` (the fingerprint as a signed long) of every row."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((simhash(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["id", "fp"])
        release_memory()

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", picked.schema["id"].dataType), T.StructField("fp", T.LongType())])
    return in_batches(picked, batches, schema).select(F.col("id").alias(id_col), "fp")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))  # of a negative number it would count the absolute value's bits


def spanning_edges(fps: np.ndarray, limit: int = MAX_DISTANCE) -> list[tuple[int, int]]:
    """Edges that connect exactly what pairs at Hamming distance <= ``limit`` connect; one less than nodes at most."""
    left = fps.copy()
    edges: list[tuple[int, int]] = []
    while left.size:
        frontier, left = left[:1], left[1:]
        while frontier.size and left.size:
            step = max(1, (1 << 21) // left.size)
            part, frontier = frontier[:step], frontier[step:]
            near = _distance(part[:, None], left[None, :]) <= limit
            hit = near.any(axis=0)
            if hit.any():
                parents = part[near[:, hit].argmax(axis=0)]
                children = left[hit]
                edges += zip(parents.tolist(), children.tolist(), strict=True)
                left = left[~hit]
                frontier = np.concatenate([frontier, children])
    return edges


_LINKS = T.StructType([T.StructField(n, T.LongType()) for n in ("key", "a", "b")])


def _bucket_links(buckets: DataFrame, bucket_limit: int | None) -> DataFrame:
    """From (key, key2, fp): edges (null, a, b); the members of a bucket beyond the limit come back as (key, fp, null)."""

    def out(keys: list, a: list, b: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, a, b)], names=["key", "a", "b"])

    def links(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        spilled: tuple[int, int] | None = None
        for batch in it:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            held = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            key, key2, fp = held
            new = np.flatnonzero((key[1:] != key[:-1]) | (key2[1:] != key2[:-1])) + 1
            starts = np.concatenate([[0], new])
            last = int(starts[-1])
            if spilled is not None:  # the first run goes on from a bucket that is already over the limit
                end = int(new[0]) if new.size else key.size
                same = (int(key[0]), int(key2[0])) == spilled
                if same:
                    yield out([spilled[0]] * end, fp[:end].tolist(), [None] * end)
                    starts, last = (starts[1:], last) if new.size else (starts[:0], key.size)
                if not same or new.size:
                    spilled = None
            yield from done(key, fp, starts)
            held = [x[last:] for x in held]
            if bucket_limit is not None and held[0].size > bucket_limit:
                spilled = (int(held[0][0]), int(held[1][0]))
                yield out([spilled[0]] * held[0].size, held[2].tolist(), [None] * held[0].size)
                held = [x[:0] for x in held]
        if held[0].size:
            yield from done(held[0], held[2], np.array([0, held[0].size]))

    def done(key: np.ndarray, fp: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(starts)
        twos = starts[:-1][sizes == 2]
        a, b = fp[twos], fp[twos + 1]
        near = _distance(a, b) <= MAX_DISTANCE
        edges = list(zip(a[near].tolist(), b[near].tolist(), strict=True))
        over: list[tuple[int, int]] = []
        for s, n in zip(starts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            if bucket_limit is not None and n > bucket_limit:
                over += ((int(key[s]), f) for f in fp[s : s + n].tolist())
            else:
                edges += spanning_edges(fp[s : s + n])
        if edges:
            yield out([None] * len(edges), [e[0] for e in edges], [e[1] for e in edges])
        if over:
            yield out([o[0] for o in over], [o[1] for o in over], [None] * len(over))

    dealt = buckets.select("key", "key2", "fp").repartition("key", "key2").sortWithinPartitions("key", "key2", "fp")
    return in_batches(dealt, links, _LINKS)


def near_links(fps: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` whose components are those of distance <= 2."""
    first = fps.select(
        "fp",
        F.explode(
            F.expr(
                """flatten(transform(sequence(0, 31), i -> array(
                    shiftleft(cast(i AS BIGINT), 32) | (shiftrightunsigned(fp, 32) & ~shiftleft(1L, i)),
                    shiftleft(cast(i + 32 AS BIGINT), 32) | (fp & 4294967295L & ~shiftleft(1L, i)))))"""
            )
        ).alias("key"),
    ).withColumn("key2", F.lit(0).cast("long"))
    found = materialise(_bucket_links(first, bucket_limit), "simhash-links")
    over = found.where("key IS NOT NULL").select("key", F.col("a").alias("fp"))
    edges = found.where("key IS NULL").select("a", "b")
    if not over.isEmpty():
        free = F.expr("IF(shiftright(key, 32) < 32, fp & 4294967295L, shiftrightunsigned(fp, 32))")
        second = over.withColumn("free", free).select(
            "key",
            "fp",
            F.explode(
                F.expr(
                    """flatten(transform(sequence(0, 15), i -> array(
                        shiftleft(cast(i AS BIGINT), 16) | (shiftright(free, 16) & ~shiftleft(1L, i)),
                        shiftleft(cast(i + 16 AS BIGINT), 16) | (free & 65535L & ~shiftleft(1L, i)))))"""
                )
            ).alias("key2"),
        )
        edges = edges.unionByName(_bucket_links(second, None).select("a", "b"))
    return edges


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) of every node with an edge, by alternating large-star and small-star steps.

    Each round ends in a written table. Minima are pre-aggregated before they are shuffled, so a hub
    with very many neighbours costs one row a task; the joins that follow are ones AQE can split.
    """
    now = materialise(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc"
    )
    seen = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(
            F.explode(
                F.array(
                    F.struct(F.col("a"), F.col("m").alias("b")),
                    F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")),
                )
            ).alias("e")
        )
        now = materialise(small.select("e.a", "e.b").where("a <> b").distinct(), "cc")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _roots(nodes: DataFrame, bucket_limit: int) -> DataFrame:
    """Every ``fp`` of ``nodes`` (one row each) with the ``root`` of its component."""
    linked = components(near_links(nodes.select("fp"), bucket_limit)).withColumnRenamed("node", "fp")
    return nodes.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id of the component) of every row."""
    prints = materialise(fingerprints(docs), "simhash")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    rooted = materialise(_roots(nodes, bucket_limit), "simhash-roots")
    ids = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    by_print = rooted.join(ids, "root").select("fp", "component_id")
    return prints.join(by_print, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, the first of repeated ones."""
    rows = numbered(docs)
    prints = materialise(
        fingerprints(rows.select("rid", F.col("row.text").alias("text")), "rid"), "simhash"
    )
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    firsts = prints.join(rows.select("rid", F.col("row.doc_id").alias("doc_id")), "rid")
    nodes = materialise(firsts.groupBy("fp").agg(F.min(order).alias("low")), "simhash-nodes")
    kept = _roots(nodes, bucket_limit).groupBy("root").agg(F.min("low").alias("low")).select("low.rid")
    return without(rows, prints.select("rid").join(kept, "rid", "left_anti"))
