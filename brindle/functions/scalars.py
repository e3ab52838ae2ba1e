"""Scalar helpers on Spark built-ins. There is one notion of a missing value: SQL NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The texts that a CSV reader with default settings takes for a missing value.
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

_NUMBER = r"^\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?)\s*$"


def quote(name: str) -> str:
    """A column name as an identifier, whatever dots, brackets and backticks it has."""
    return "`" + name.replace("`", "``") + "`"


def null_if_nan(c: Column, kind: T.DataType | None = None) -> Column:
    """NULL for NaN in floating-point columns; NaN > 0 is true in Spark and NaN poisons sums."""
    if kind is not None and not isinstance(kind, (T.DoubleType, T.FloatType)):
        return c
    return F.when(~F.isnan(c), c)


def null_if_na_token(c: Column) -> Column:
    return F.when(~c.isin(*NA_TOKENS), c)


def to_numeric(c: Column, kind: T.DataType | None = None) -> Column:
    """A number, or NULL where the value doesn't read as one. Texts are held to plain decimal notation first:
    Spark's cast would also take '1d' and '1f'."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return null_if_nan(c.cast("double"))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    text = c.cast("string")
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def to_timestamp(c: Column, fmt: str = "yyyy-M-d", kind: T.DataType | None = None) -> Column:
    """A timestamp without zone, or NULL; texts must have the one declared format."""
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp_ntz")
    return F.try_to_timestamp(c.cast("string"), F.lit(fmt)).cast("timestamp_ntz")


def to_date(c: Column, fmt: str = "yyyy-M-d", kind: T.DataType | None = None) -> Column:
    """A date, or NULL; texts must have the one declared format."""
    return to_timestamp(c, fmt, kind).cast("date")


def safe_div(a: Column, b: Column) -> Column:
    """a / b where b > 0, else NULL: zero, negative and missing divisors have no ratio."""
    return F.when(b > 0, a / b)


def presence(c: Column) -> Column:
    """Never null: whether the value is there."""
    return c.isNotNull()
