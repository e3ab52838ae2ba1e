"""Cleaning steps; each returns a new DataFrame, so steps compose with ``transform``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.functions import null_if_nan, quote, to_timestamp

MATCH_KEYS = ("EventId", "EventYear", "MatchId")
DATE = "yyyy-M-d"
#: A date, and after a blank or T the time to the minute, second or fraction.
DATETIME = "yyyy-M-d[[ ]['T']H:m[:s[.SSSSSS][.SSS]]]"
#: The date columns of the data, with the format of each.
DATE_FORMATS = {"StartDate": DATE, "EndDate": DATETIME, "PlayerTeam1.RankDate": DATE, "PlayerTeam2.RankDate": DATE}
#: Where a row came from: set by the CSV reader, so that "first" means first in file order.
SOURCE_ORDER = ("_src_file", "_src_block", "_src_row")


def drop_index_column(df: DataFrame, name: str = "Unnamed: 0") -> DataFrame:
    """Without the saved row index, if there is one; only the exact name goes."""
    return df.drop(name) if name in df.columns else df


def drop_by_suffix(df: DataFrame, suffix: str = ".Percent") -> DataFrame:
    """Without the columns whose name ends so; the scan never reads them."""
    return df.select(*(F.col(quote(c)) for c in df.columns if not c.endswith(suffix)))


def dedup_first(df: DataFrame, keys: Sequence[str] | None = None, order: Sequence[str | Column] = SOURCE_ORDER) -> DataFrame:
    """The first row, by ``order``, of each combination of the keys that exist; missing keys (NULL or NaN) are equal.

    Without any key column, the rows as they are. With some only, those alone decide. The row number
    limit is pushed below the shuffle by the optimiser's group limit, so a key that a third of all rows
    share sends one row a task.
    """
    present = [k for k in (MATCH_KEYS if keys is None else keys) if k in df.columns]
    if not present:
        return df
    by = [F.col(quote(o)).asc_nulls_first() if isinstance(o, str) else o for o in order if not isinstance(o, str) or o in df.columns]
    by = by or [F.monotonically_increasing_id()]
    rank = F.row_number().over(Window.partitionBy(*(null_if_nan(F.col(quote(k)), df.schema[k].dataType) for k in present)).orderBy(*by))
    return df.withColumn("_first", rank).where("_first = 1").drop("_first")


def coerce_dates(df: DataFrame, formats: Mapping[str, str] = DATE_FORMATS) -> DataFrame:
    """Date columns (name to format) that exist as timestamps without zone; what doesn't have the column's format becomes NULL."""
    there = {c: f for c, f in formats.items() if c in df.columns}
    return df.withColumns({c: to_timestamp(F.col(quote(c)), f, df.schema[c].dataType) for c, f in there.items()}) if there else df


def preprocess(df: DataFrame, keys: Sequence[str] | None = None, order: Sequence[str | Column] = SOURCE_ORDER) -> DataFrame:
    """Index column, duplicates, dates and percent columns, in this order."""
    return (
        df.transform(drop_index_column)
        .transform(lambda d: dedup_first(d, keys, order))
        .transform(coerce_dates)
        .transform(drop_by_suffix)
    )
