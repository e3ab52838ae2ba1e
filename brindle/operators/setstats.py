"""Wide to long, and statistics of rates and totals per base and set.

All cells of a row become an array of structs that one ``inline`` unfolds, so every base, team and set is
read in one scan and aggregated in one shuffle of at most a few rows per base, set and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from brindle.functions import null_if_nan, quote, safe_div, to_numeric
from brindle.operators.cells import DEFAULT_BASE, Catalogue, Cell
from brindle.operators.clean import MATCH_KEYS

SET_STATS = T.StructType(
    [
        T.StructField("stat_base", T.StringType()),
        T.StructField("set_number", T.IntegerType()),
        T.StructField("rate_mean", T.DoubleType()),
        T.StructField("rate_std", T.DoubleType()),
        T.StructField("rate_n", T.LongType()),
        T.StructField("total_mean", T.DoubleType()),
        T.StructField("total_std", T.DoubleType()),
        T.StructField("total_n", T.LongType()),
    ]
)
CELLS = "stat_base string, set_number int, team string, rate double, total double, has_total boolean, has_valid_rate boolean"


def _number(df: DataFrame, name: str) -> Column:
    return to_numeric(F.col(quote(name)), df.schema[name].dataType)


def wide_to_long(df: DataFrame, catalogue: Catalogue | None = None, keys: Sequence[str] = (), drop_empty: bool = False) -> DataFrame:
    """A row per input row and existing cell: keys, stat_base, set_number, team, rate, total, has_total and
    has_valid_rate. ``set_number`` is the index plus one. ``drop_empty`` leaves out cells without a
    denominator, which add nothing to any statistic but the existence of a group."""
    catalogue = catalogue or Catalogue.of(df)
    cells = catalogue.ratio_cells()
    keys = [k for k in keys if k in df.columns]
    if not cells:
        head = T.StructType([df.schema[k] for k in keys])
        return df.sparkSession.createDataFrame([], T.StructType([*head.fields, *T._parse_datatype_string(CELLS).fields]))

    def one(c: Cell) -> Column:
        return F.struct(
            F.lit(c.base).alias("stat_base"),
            F.lit(c.set_index + 1).alias("set_number"),
            F.lit(c.team).alias("team"),
            _number(df, c.dividend).alias("x"),
            _number(df, c.divisor).alias("y"),
        )

    array = F.array(*map(one, cells))
    if drop_empty:
        array = F.filter(array, lambda c: c["y"].isNotNull())
    kept = [F.col(quote(k)) for k in keys]
    x, y = F.col("x"), F.col("y")
    return df.select(*kept, F.inline(array)).select(
        *kept,
        "stat_base",
        "set_number",
        "team",
        safe_div(x, y).alias("rate"),
        y.alias("total"),
        y.isNotNull().alias("has_total"),
        F.coalesce((y > 0) & x.isNotNull(), F.lit(False)).alias("has_valid_rate"),
    )


def cell(df: DataFrame, team: str, set_index: int, base: str) -> DataFrame | None:
    """The long rows of one position, or None unless both of its columns exist."""
    c = Cell(team, set_index, base)
    if not {c.dividend, c.divisor} <= set(df.columns):
        return None
    only = Catalogue(frozenset(df.columns), (base,), (team,), (set_index,))
    return wide_to_long(df, only).drop("stat_base")


def rate_and_total_stats(long: DataFrame) -> DataFrame:
    """Mean, sample deviation and count of rates and totals per base and set; both teams count alike."""
    return long.groupBy("stat_base", "set_number").agg(
        F.avg("rate").alias("rate_mean"),
        F.stddev_samp("rate").alias("rate_std"),
        F.count_if("has_valid_rate").alias("rate_n"),
        F.avg("total").alias("total_mean"),
        F.stddev_samp("total").alias("total_std"),
        F.count_if("has_total").alias("total_n"),
    )


def with_stat_total(stats: DataFrame) -> DataFrame:
    """Adds total_rate_n_for_stat: the sum of rate_n over a base's sets."""
    return stats.withColumn("total_rate_n_for_stat", F.sum("rate_n").over(Window.partitionBy("stat_base")))


def set_stats(df: DataFrame, min_rate_n: int = 1, min_total_n: int = 1, catalogue: Catalogue | None = None) -> DataFrame:
    """Statistics of every base and set with enough rates and totals, best covered base first.

    The result has the columns of SET_STATS, also when there is no base or nothing passes. The order's
    totals are taken after the filter.
    """
    catalogue = catalogue or Catalogue.of(df)
    if not catalogue.ratio_cells():
        return df.sparkSession.createDataFrame([], SET_STATS)
    drop_empty = min_rate_n >= 1 or min_total_n >= 1  # groups of empty cells alone would not pass
    stats = rate_and_total_stats(wide_to_long(df, catalogue, drop_empty=drop_empty))
    passed = stats.where((F.col("rate_n") >= min_rate_n) & (F.col("total_n") >= min_total_n))
    ordered = with_stat_total(passed).orderBy(F.desc("total_rate_n_for_stat"), "stat_base", "set_number")
    return ordered.select(*SET_STATS.names)


def match_points(df: DataFrame, base: str = DEFAULT_BASE, keys: Sequence[str] = MATCH_KEYS, team: str = "PlayerTeam1", catalogue: Catalogue | None = None) -> DataFrame:
    """Points per match and set: the sum of one team's denominators; missing if all are missing.

    Missing keys (NULL or NaN) are one key like others. Without any denominator column there is nothing to sum, and a
    ValueError says so.
    """
    catalogue = catalogue or Catalogue.of(df)
    cells = catalogue.total_cells(base, (team,))
    if not cells:
        raise ValueError(f"no column holds a denominator of {base!r}")
    keys = [k for k in keys if k in df.columns]
    array = F.array(*(F.struct(F.lit(c.set_index + 1).alias("set_number"), _number(df, c.divisor).alias("total")) for c in cells))
    long = df.select(*(null_if_nan(F.col(quote(k)), df.schema[k].dataType).alias(k) for k in keys), F.inline(array))
    return long.groupBy(*(F.col(quote(k)) for k in keys), "set_number").agg(F.sum("total").alias("points_played"))


def set_total(df: DataFrame, team: str, set_index: int, base: str, keys: Sequence[str]) -> DataFrame | None:
    """set_number, total and the keys of each row for one position, or None if its column is absent."""
    c = Cell(team, set_index, base)
    if c.divisor not in df.columns:
        return None
    return df.select(F.lit(set_index + 1).alias("set_number"), _number(df, c.divisor).alias("total"), *(F.col(quote(k)) for k in keys))


def points_per_set(df: DataFrame, base: str = DEFAULT_BASE, keys: Sequence[str] = MATCH_KEYS, team: str = "PlayerTeam1") -> DataFrame:
    """Average points played and number of matches with points, by set number in order."""
    return (
        match_points(df, base, keys, team)
        .groupBy("set_number")
        .agg(F.avg("points_played").alias("avg_points_played"), F.count("points_played").alias("n"))
        .orderBy("set_number")
    )


def points_chart(summary: DataFrame) -> DataFrame:
    """The two columns of a bar chart: set number as text, average points."""
    return summary.select(F.col("set_number").cast("string").alias("set_label"), "avg_points_played")
