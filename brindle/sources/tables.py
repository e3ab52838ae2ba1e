"""Reading and writing wide tables.

CSV files of one folder need not have the same columns, nor the same order of columns. Spark binds a
glob of CSV files to the first header by position, so files are grouped by their header line, each group
is one scan, and the scans are united by name. Header lines are read by the driver from the file system, many files at a
time, without a Spark job. Quoted values may hold separators, doubled quotes and line breaks; a file is therefore
read as a whole by one task, and its rows are in order.
"""

from __future__ import annotations

import csv
import re
import tempfile
import uuid
from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import null_if_na_token, quote, to_numeric, to_timestamp


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, sorted; any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or ())


def _first_record(spark: SparkSession, path: str) -> str:
    """The first line of a file that isn't blank, and those after it as long as a quoted value is open."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(conf).open(at)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
    try:
        record = ""
        while (line := reader.readLine()) is not None:
            record += line + "\n"
            if record.strip() and record.count('"') % 2 == 0:
                break
            record = record if record.strip() else ""
        return record.removeprefix("\ufeff")
    finally:
        reader.close()


def column_names(record: str) -> tuple[str, ...]:
    """Names of a header: an empty one is named by its place, as a saved row index is, and a repeated one is numbered."""
    names: list[str] = []
    for i, given in enumerate(next(csv.reader([record.rstrip("\n")]), [])):
        name, n = given or f"Unnamed: {i}", 0
        while name in names:
            n += 1
            name = f"{given or f'Unnamed: {i}'}.{n}"
        names.append(name)
    return tuple(names)


def _headers(spark: SparkSession, paths: Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by header."""
    groups: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(32) as pool:
        for path, record in zip(paths, pool.map(lambda p: _first_record(spark, p), paths), strict=True):
            if record:  # a file without a header has no rows
                groups.setdefault(column_names(record), []).append(path)
    return groups


def read_csvs(
    spark: SparkSession, paths: str | Sequence[str], schema: Mapping[str, str] | None = None, infer: bool = True
) -> DataFrame:
    """All files as one table by column name; a column that a file lacks is NULL there.

    The usual marks of a missing value become NULL, and the columns in ``schema`` (name to ``string``, ``double``, ``int``,
    ``date`` or ``timestamp``) are cast leniently. The others get the kind that all their values have (see
    ``infer_kinds``; one more pass over the files, which ``infer=False`` or a full schema spares), or stay text.
    ``_src_file``, ``_src_block`` and ``_src_row`` keep the order of files and lines. No file raises FileNotFoundError, and
    files that are all empty a ValueError.
    """
    paths = list_files(spark, paths) if isinstance(paths, str) else list(paths)
    if not paths:
        raise FileNotFoundError("no CSV file matches")
    scans = []
    for columns, files in _headers(spark, paths).items():
        kind = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        raw = spark.read.options(header=True, quote='"', escape='"', multiLine=True).schema(kind).csv(files)
        scans.append(
            raw.select(
                *(null_if_na_token(F.col(quote(c))).alias(c) for c in columns),
                F.col("_metadata.file_path").alias("_src_file"),
                F.col("_metadata.file_block_start").alias("_src_block"),
                F.monotonically_increasing_id().alias("_src_row"),
            )
        )
    if not scans:
        raise ValueError("no CSV file has a header")
    df, kinds = union_by_name(scans), dict(schema or {})
    if infer:
        kinds |= infer_kinds(df, [c for c in df.columns if c not in kinds and not c.startswith("_src_")])
    return cast_columns(df, kinds)


_INTEGER = r"^\s*[+-]?[0-9]{1,18}\s*$"
_BOOLEAN = ("True", "TRUE", "true", "False", "FALSE", "false")


def infer_kinds(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Kinds of text columns by all of their values, in one pass: ``long``, ``double`` or ``boolean`` where every value that
    is there reads as one; other columns, and those without a value, are left out. A missing value makes no integer a double."""
    if not columns:
        return {}
    tests = {
        "long": lambda c: c.rlike(_INTEGER),
        "double": lambda c: to_numeric(c).isNotNull(),
        "boolean": lambda c: c.isin(*_BOOLEAN),
    }
    each = [F.struct(F.count(F.col(quote(c))).alias("n"), *(F.count_if(test(F.col(quote(c)))).alias(k) for k, test in tests.items())) for c in columns]
    counts = df.agg(F.array(*each).alias("counts")).first().counts
    found = {c: next((k for k in tests if r[k] == r.n), None) for c, r in zip(columns, counts, strict=True) if r.n}
    return {c: k for c, k in found.items() if k}


def cast_columns(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """Columns that exist in the kinds declared; what can't be read is NULL."""
    made = {}
    for name, kind in schema.items():
        if name not in df.columns:
            continue
        c, now = F.col(quote(name)), df.schema[name].dataType
        if kind in ("date", "timestamp"):
            made[name] = to_timestamp(c, kind=now).cast("date" if kind == "date" else "timestamp_ntz")
        elif kind == "string":
            made[name] = c.cast("string")
        elif kind in ("long", "boolean") and isinstance(now, T.StringType):
            made[name] = F.trim(c).try_cast(kind)
        else:
            made[name] = to_numeric(c, now).try_cast(kind)
    return df.withColumns(made) if made else df


def union_by_name(frames: Iterable[DataFrame]) -> DataFrame:
    """All rows; columns that a frame lacks are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share; a local one only where all run in one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = f"file://{tempfile.gettempdir()}"
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def write_cache(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def rows_frame(spark: SparkSession, rows: Sequence, schema: T.StructType | str) -> DataFrame:
    """A table from rows in memory; the schema is always given."""
    return spark.createDataFrame(rows, schema)


def print_columns(df: DataFrame) -> list[str]:
    print(df.columns)
    return df.columns


def report(tables: Mapping[str, DataFrame], rows: int = 30, truncate: bool = False) -> None:
    """Prints each table under its name."""
    for name, table in tables.items():
        print(f"\n=== {name} ===\n")
        table.show(rows, truncate)
