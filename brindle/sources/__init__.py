"""Readers and sinks: many CSV files by column name, Parquet cache, console reports."""

from brindle.sources.tables import (
    column_names,
    infer_kinds,
    list_files,
    print_columns,
    read_cache,
    read_csvs,
    report,
    rows_frame,
    scratch_path,
    union_by_name,
    write_cache,
)

__all__ = [
    "column_names",
    "infer_kinds",
    "list_files",
    "print_columns",
    "read_cache",
    "read_csvs",
    "report",
    "rows_frame",
    "scratch_path",
    "union_by_name",
    "write_cache",
]
