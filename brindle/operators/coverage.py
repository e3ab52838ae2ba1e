"""Presence flags and how their share depends on other columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.functions import null_if_nan, quote
from brindle.operators.cells import DEFAULT_BASE, TEAMS, Cell

#: Names of the flags, and the columns that coverage is asked about.
FLAGS = ("has_set2_stats", "has_set3_stats", "has_set2_and_3_stats")
DRIVERS = (
    "EventYear",
    "EventType",
    "TournamentName",
    "Singles",
    "Doubles",
    "InOutdoor",
    "Court",
    "TourneyLocation",
    "Round.ShortName",
    "Round.LongName",
    "PlayerTeam1.PlayerCountryCode",
    "PlayerTeam2.PlayerCountryCode",
)


def add_set_flags(df: DataFrame, base: str = DEFAULT_BASE) -> DataFrame:
    """Adds whether set 2, set 3 and both have statistics: either team's denominator is there (zero counts).
    An absent column is a missing value. The flags are never null."""

    def there(set_index: int) -> Column:
        names = [Cell(t, set_index, base).divisor for t in TEAMS]
        found = [null_if_nan(F.col(quote(n)), df.schema[n].dataType).isNotNull() for n in names if n in df.columns]
        return found[0] | found[1] if len(found) == 2 else found[0] if found else F.lit(False)

    second, third = there(1), there(2)
    return df.withColumns(dict(zip(FLAGS, (second, third, second & third), strict=True)))


def flag_totals(df: DataFrame) -> DataFrame:
    """One row: rows, how many have each flag, and the share with both."""
    return df.agg(
        F.count("*").alias("n_rows"),
        *(F.count_if(F.col(f)).alias(f"n_{f}") for f in FLAGS),
        F.avg(F.col(FLAGS[2]).cast("double")).alias("share_with_both"),
    )


def coverage_by(df: DataFrame, column: str, flag: str = FLAGS[2], top_n: int = 25, min_count: int = 50) -> DataFrame | None:
    """Per value of a column (missing, NULL or NaN, is one value): total, flag_count and flag_rate of groups of at least
    ``min_count`` rows, the best covered ``top_n`` first; ties by the value, missing last. None if there is
    no such column."""
    if column not in df.columns:
        return None
    key, on = null_if_nan(F.col(quote(column)), df.schema[column].dataType).alias(column), F.col(quote(flag))
    return (
        df.groupBy(key)
        .agg(F.count(on).alias("total"), F.count_if(on).alias("flag_count"), F.avg(on.cast("double")).alias("flag_rate"))
        .where(F.col("total") >= min_count)
        .orderBy(F.desc("flag_rate"), F.desc("flag_count"), F.col(quote(column)).asc_nulls_last())
        .limit(top_n)
    )


def coverage_tables(df: DataFrame, columns: Sequence[str] = DRIVERS, flag: str = FLAGS[2], top_n: int = 30, min_count: int = 50) -> dict[str, DataFrame]:
    """coverage_by for each column that exists and has a group large enough."""
    found = {c: coverage_by(df, c, flag, top_n, min_count) for c in columns}
    return {c: t for c, t in found.items() if t is not None and not t.isEmpty()}


def coverage_sweep(df: DataFrame, columns: Sequence[str] = DRIVERS, flag: str = FLAGS[2], top_n: int = 30, min_count: int = 50) -> DataFrame:
    """The same as one tidy table from one scan: driver, value (as text), total, flag_count, flag_rate, rank.

    Each row is counted once under each column by an unfolded array, and a third of all rows with the same
    value are summed in their tasks before the shuffle.
    """
    there = [c for c in columns if c in df.columns]
    if not there:
        empty = "driver string, value string, total long, flag_count long, flag_rate double, rank int"
        return df.sparkSession.createDataFrame([], empty)
    on = F.col(quote(flag))
    pairs = F.array(*(F.struct(F.lit(c).alias("driver"), null_if_nan(F.col(quote(c)), df.schema[c].dataType).cast("string").alias("value")) for c in there))
    grouped = (
        df.select(on.alias("on"), F.inline(pairs))
        .groupBy("driver", "value")
        .agg(F.count("on").alias("total"), F.count_if("on").alias("flag_count"), F.avg(F.col("on").cast("double")).alias("flag_rate"))
        .where(F.col("total") >= min_count)
    )
    order = Window.partitionBy("driver").orderBy(F.desc("flag_rate"), F.desc("flag_count"), F.col("value").asc_nulls_last())
    return grouped.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)
