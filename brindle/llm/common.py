"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Parquet writers hold a row group on the heap; small ones keep several tasks of an executor small.
ROW_GROUP_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where ``spark.checkpoint.dir`` is unset, a local one is set if all
    run in one process (tests); on a cluster nobody knows one then, and that raises."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.gettempdir()}/brindle-shared"
    return f"{path.rstrip('/')}/brindle"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, and a lost executor loses nothing.

    The table stays as long as results may read it; ``clean_shared`` deletes all that a session has left.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean_shared(spark: SparkSession) -> bool:
    """Deletes what this application has written between steps; for when its results are written or no longer needed."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Arrow batches end at so many bytes: ten thousand long texts would fill an executor, or pass Arrow's 2 GB.
BATCH_BYTES = 4_000_000


def in_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with batches of about ``BATCH_BYTES`` (a row is never cut); the session keeps that setting.

    A function that gains from larger batches puts some together itself (``gathered``).
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(function, schema)


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def release_memory() -> None:
    """Gives a worker's free memory back to the system at the end of a task: idle workers stay alive."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: At most so many row numbers (8 MB) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def numbered(df: DataFrame) -> DataFrame:
    """``row`` (a struct of all columns, whatever their names) and ``rid``, written so that rids stay the same."""
    return materialise(df.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("rid")), "rows")


def without(rows: DataFrame, rids: DataFrame) -> DataFrame:
    """The rows of ``numbered`` that are not in ``rids`` (column rid), as they came."""
    gone = materialise(rids.select("rid"), "rids")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return rows.join(gone, "rid", "left_anti").select("row.*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(files: DataFrame) -> DataFrame:
    """A table read from Parquet files, with its rows dealt over all cores if its row groups would leave half of them idle.

    One task reads a row group, however much work its rows are. Tables of a full split for each core are left as they are,
    unseen; of smaller ones the row groups are counted, from the files' footers.
    """
    spark = files.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() >= cores * _split_bytes(spark):
        return files
    meta = files.metadataColumn("_metadata")
    groups = files.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("start")).distinct().count()
    return files.repartition(cores) if 0 < 2 * groups <= cores else files


def _split_bytes(spark: SparkSession) -> int:
    return spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()


def ascii_lower(text):
    """Lower-case A-Z only. ``lower`` agrees on pure ASCII and is much faster there."""
    text = F.col(text) if isinstance(text, str) else text
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )
