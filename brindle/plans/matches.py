"""The driver's orders and lineitem as wide match rows.

A match is an order; set index is the line number less one; team 1 are lines with status 'F', team 2
those with 'O'. Base ``Stats.A.TaxPerDiscount`` is tax over discount and ``Stats.B.PricePerQty`` price
over quantity. Of lines with the same order and number the first counts, by part, supplier, ship date,
price and the remaining columns; lines are shuffled once, by order, for that and for the cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.cells import Cell

BASE_A, BASE_B = "Stats.A.TaxPerDiscount", "Stats.B.PricePerQty"
LINE_KEYS = ("l_orderkey", "l_linenumber")
LINE_ORDER = (
    "l_partkey",
    "l_suppkey",
    "l_shipdate",
    "l_extendedprice",
    "l_quantity",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
)
_TEAM = {"F": "PlayerTeam1", "O": "PlayerTeam2"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each order and number, dealt by order."""
    dealt = table(spark, sf_dir, "lineitem").select(*LINE_KEYS, *LINE_ORDER).repartition("l_orderkey")
    return dealt.groupBy(*LINE_KEYS).agg(F.min(F.struct(*LINE_ORDER)).alias("first")).select(*LINE_KEYS, "first.*")


def matches(spark: SparkSession, sf_dir: str, indices: range = range(7)) -> DataFrame:
    """One row per order with its lines' cells; index 6 exists and is beyond what the operators read."""
    lines = first_lines(spark, sf_dir)
    cells = []
    for index in indices:
        for status, team in _TEAM.items():
            here = (F.col("l_linenumber") == index + 1) & (F.col("l_linestatus") == status)
            for base, x, y in ((BASE_A, "l_tax", "l_discount"), (BASE_B, "l_extendedprice", "l_quantity")):
                cell = Cell(team, index, base)
                cells.append(F.max(F.when(here, F.col(x))).alias(cell.dividend))
                cells.append(F.max(F.when(here, F.col(y))).alias(cell.divisor))
    wide = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*cells)
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_orderkey").alias("EventId"),
        F.year("o_orderdate").alias("EventYear"),
        F.col("o_orderkey").cast("string").alias("MatchId"),
        F.col("o_orderstatus").alias("Court"),
        F.col("o_orderpriority").alias("EventType"),
    )
    return orders.join(wide, "o_orderkey", "left").drop("o_orderkey")


#: The same in SQL, long: one row per order and first line.
ORACLE_LINES = f"""
WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(LINE_KEYS)} ORDER BY {', '.join(LINE_ORDER)}) AS rn
           FROM lineitem) WHERE rn = 1),
m AS (SELECT o_orderkey AS eid, CAST(year(o_orderdate) AS INTEGER) AS ey, CAST(o_orderkey AS VARCHAR) AS mid, o_orderstatus AS court,
      o_orderpriority AS etype FROM orders),
l AS (SELECT l_orderkey AS eid, l_linenumber AS sn, CASE l_linestatus WHEN 'F' THEN 'PlayerTeam1' ELSE 'PlayerTeam2' END AS team,
      l_tax, l_discount, l_extendedprice, l_quantity FROM f WHERE l_linenumber BETWEEN 1 AND 6 AND l_orderkey IN (SELECT eid FROM m)),
c AS (SELECT eid, sn, team, '{BASE_A}' AS base, l_tax AS x, l_discount AS y FROM l
      UNION ALL SELECT eid, sn, team, '{BASE_B}', l_extendedprice, l_quantity FROM l),
g AS (SELECT m.*, coalesce(s2, false) AS s2, coalesce(s3, false) AS s3, coalesce(s2, false) AND coalesce(s3, false) AS both_sets
      FROM m LEFT JOIN (SELECT eid, bool_or(sn = 2) AS s2, bool_or(sn = 3) AS s3 FROM l GROUP BY eid) USING (eid))
"""
