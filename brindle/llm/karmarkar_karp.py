"""Byte-balanced shards by Karmarkar-Karp differencing of indivisible groups.

Rows of equal text are one group and stay in one shard. A group whose bytes exceed one part in
``BINS`` of the total is an item of its own (so there are fewer than ``BINS`` of those); all others
are folded by hash into ``BINS`` bins, which are the remaining items. The largest differencing method
combines, again and again, the two partial partitions of largest spread, the heaviest shard of one
with the lightest of the other. That needs at most 2 * BINS sums on the driver at any size of input.

Slots run from 0 without gaps in each shard: rows are counted per shard and block of ``BLOCK`` input rows, and blocks per
super-block of ``BLOCK`` blocks. Rows are numbered within their block, blocks offset within their super-block, and
super-blocks within the shard; the last is the only window over a whole shard, and it has a row for a million input rows.
So no shard, text or id is ever gathered in one task, however common it is.

Defined results: a null text has size 16, checksum 0 and forms a group with the other null texts,
apart from empty ones. Repeated rows and null ids are rows like others. An empty table gives an empty
result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from brindle.llm.common import materialise

OVERHEAD = 16
BINS = 4096
BLOCK = 1024


def difference(sizes: list[int], shards: int) -> list[int]:
    """Shard of each item: the largest differencing method for ``shards`` parts. Ties go by item order."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    # a partial partition: (-spread, age, sums ascending, items of each sum as nested pairs)
    heap = []
    for i, size in enumerate(sizes):
        sums, items = [0] * (shards - 1) + [size], [None] * (shards - 1) + [i]
        heap.append((-(sums[-1] - sums[0]), i, sums, items))
    heapq.heapify(heap)
    age = len(heap)
    while len(heap) > 1:
        _, _, a_sums, a_items = heapq.heappop(heap)
        _, _, b_sums, b_items = heapq.heappop(heap)
        joined = sorted(
            ((a_sums[k] + b_sums[-1 - k], k) for k in range(shards)), key=lambda x: x[0]
        )
        low = joined[0][0]
        sums = [s - low for s, _ in joined]
        items = [_pair(a_items[k], b_items[-1 - k]) for _, k in joined]
        heapq.heappush(heap, (-(sums[-1] - sums[0]), age, sums, items))
        age += 1
    out = [0] * len(sizes)
    for shard, tree in enumerate(heap[0][3] if heap else []):
        todo = [tree]
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                todo += node
            elif node is not None:
                out[node] = shard
    return out


def _pair(a, b):
    return b if a is None else a if b is None else (a, b)


def shards(docs: DataFrame, n_shards: int, bins: int = BINS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(text.isNull(), text).alias("g"),
        F.monotonically_increasing_id().alias("at"),
    )
    rows = materialise(rows, "shard-rows").withColumn("bin", F.pmod(F.xxhash64("g"), F.lit(bins)))
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = rows.groupBy("g", "bin").agg(F.sum("size").alias("size"))
    heavy = F.col("size") * bins > total
    items = (
        groups.select(F.when(heavy, F.col("g")).alias("heavy"), F.when(~heavy, F.col("bin")).alias("bin"), "size")
        .groupBy("heavy", "bin")
        .agg(F.sum("size").alias("size"))
        .orderBy(F.desc("size"), "heavy", "bin")
        .collect()
    )  # fewer than 2 * bins rows
    chosen = difference([r["size"] for r in items], n_shards)
    assigned = [(r["heavy"], r["bin"], c) for r, c in zip(items, chosen, strict=True)]
    by_group = [(h, c) for h, _, c in assigned if h is not None]
    by_bin = [(b, c) for _, b, c in assigned if b is not None]
    group_schema = T.StructType([T.StructField("g", T.LongType()), T.StructField("own", T.IntegerType())])
    bin_schema = T.StructType([T.StructField("bin", T.LongType()), T.StructField("folded", T.IntegerType())])
    placed = (
        rows.join(F.broadcast(spark.createDataFrame(by_group, group_schema)), "g", "left")
        .join(F.broadcast(spark.createDataFrame(by_bin, bin_schema)), "bin", "left")
        .select("doc_id", "size", "text_crc32", "at", F.coalesce("own", "folded").alias("shard"))
    )
    return with_slots(placed)


def with_slots(placed: DataFrame) -> DataFrame:
    """Adds the slot: the rank of ``at`` within the shard, from 0."""
    bits = BLOCK.bit_length() - 1
    placed = placed.withColumn("block", F.shiftright("at", bits))
    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("n")).withColumn("super", F.shiftright("block", bits))
    before = lambda *by: Window.partitionBy("shard", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.withColumn("inner", F.coalesce(F.sum("n").over(before("super", "block")), F.lit(0)))
    supers = counts.groupBy("shard", "super").agg(F.sum("n").alias("n"))
    supers = supers.select("shard", "super", F.coalesce(F.sum("n").over(before("super")), F.lit(0)).alias("outer"))
    offsets = blocks.join(supers, ["shard", "super"]).select("shard", "block", (F.col("inner") + F.col("outer")).alias("offset"))
    within = F.row_number().over(Window.partitionBy("shard", "block").orderBy("at"))
    return (
        placed.withColumn("rank", within)
        .join(offsets, ["shard", "block"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
