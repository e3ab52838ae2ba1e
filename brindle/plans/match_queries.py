"""Queries of the match operators over the driver's tables, and independent SQL for each.

Doubles are rounded on both sides, as parallel sums differ in their last bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import safe_div, to_date, to_numeric
from brindle.operators import clean, coverage, setstats
from brindle.plans.matches import BASE_A, BASE_B, LINE_KEYS, LINE_ORDER, ORACLE_LINES, matches, table
from brindle.sources import read_cache, read_csvs, scratch_path, union_by_name, write_cache

PLACES = 6


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, PLACES) for c in columns})


def dedup_first(spark, sf_dir):
    return clean.dedup_first(table(spark, sf_dir, "lineitem"), LINE_KEYS, LINE_ORDER).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"
    )


def dedup_partial_key(spark, sf_dir):
    keys = ("l_suppkey", "EventYear", "MatchId")  # the last two don't exist
    order = ("l_orderkey", "l_linenumber", *LINE_ORDER)
    return clean.dedup_first(table(spark, sf_dir, "lineitem"), keys, order).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")


def drop_columns_by_suffix(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    wide = orders.select(
        F.col("o_custkey").alias("Unnamed: 0"),
        F.col("o_orderkey").alias("Unnamed: 1"),
        F.col("o_totalprice").alias("X.Percent"),
        F.col("o_orderstatus").alias("PercentX"),
        F.col("o_orderpriority").alias("X.Percent.Y"),
    )
    left = clean.drop_by_suffix(clean.drop_index_column(wide))
    return left.toDF("unnamed_1", "percent_x", "percent_y")


def lenient_numeric_cast(spark, sf_dir):
    digits = F.regexp_extract("props", r"([0-9]+)", 1)
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), digits.alias("raw"))
    texts = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("text").alias("raw"))
    return events.unionByName(texts).select("id", to_numeric(F.col("raw")).alias("number"))


def lenient_date_cast(spark, sf_dir):
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    bad = F.element_at(F.array(*map(F.lit, ("2024-13-01", "2024", "x", "01/05/2024"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    raw = F.when(F.col("o_orderkey") % 5 == 0, bad).otherwise(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", to_date(raw).alias("day"))


def safe_ratio(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", F.round(safe_div(F.col("l_tax"), F.col("l_discount")), PLACES).alias("rate"))


def _flagged(spark, sf_dir) -> DataFrame:
    return coverage.add_set_flags(matches(spark, sf_dir), BASE_B)


def presence_flags(spark, sf_dir):
    return _flagged(spark, sf_dir).select("EventId", *coverage.FLAGS)


def flag_totals(spark, sf_dir):
    return _rounded(coverage.flag_totals(_flagged(spark, sf_dir)), "share_with_both")


def coverage_by_priority(spark, sf_dir):
    return _rounded(coverage.coverage_by(_flagged(spark, sf_dir), "EventType"), "flag_rate")


def coverage_by_status(spark, sf_dir):
    return _rounded(coverage.coverage_by(_flagged(spark, sf_dir), "Court"), "flag_rate")


def coverage_by_year(spark, sf_dir):
    return _rounded(coverage.coverage_by(_flagged(spark, sf_dir), "EventYear", min_count=1), "flag_rate")


def coverage_min_count(spark, sf_dir):
    return _rounded(coverage.coverage_by(_flagged(spark, sf_dir), "EventYear", min_count=2100), "flag_rate")


def coverage_top_n(spark, sf_dir):
    return _rounded(coverage.coverage_by(_flagged(spark, sf_dir), "EventType", top_n=2, min_count=1), "flag_rate")


def coverage_null_group(spark, sf_dir):
    df = _flagged(spark, sf_dir).withColumn("Court", F.nullif("Court", F.lit("P")))
    return _rounded(coverage.coverage_by(df, "Court", min_count=1), "flag_rate")


def coverage_sweep(spark, sf_dir):
    return _rounded(coverage.coverage_sweep(_flagged(spark, sf_dir), min_count=1), "flag_rate")


def wide_to_long(spark, sf_dir):
    long = setstats.wide_to_long(matches(spark, sf_dir), keys=("EventId",))
    return _rounded(long, "rate", "total")


def _stats(spark, sf_dir, **mins) -> DataFrame:
    return _rounded(setstats.set_stats(matches(spark, sf_dir), **mins), "rate_mean", "rate_std", "total_mean", "total_std")


def set_stats(spark, sf_dir):
    return _stats(spark, sf_dir)


def set_stats_min_zero(spark, sf_dir):
    return _stats(spark, sf_dir, min_rate_n=0, min_total_n=0)


def set_stats_top30(spark, sf_dir):
    return _stats(spark, sf_dir).limit(30)


def stat_totals_window(spark, sf_dir):
    stats = setstats.rate_and_total_stats(setstats.wide_to_long(matches(spark, sf_dir), drop_empty=True))
    return setstats.with_stat_total(stats).select("stat_base", "set_number", "rate_n", "total_rate_n_for_stat")


def points_per_match_set(spark, sf_dir):
    return _rounded(setstats.match_points(matches(spark, sf_dir), BASE_B), "points_played")


def points_per_set(spark, sf_dir):
    return _rounded(setstats.points_per_set(matches(spark, sf_dir), BASE_B), "avg_points_played")


def points_chart(spark, sf_dir):
    return _rounded(setstats.points_chart(setstats.points_per_set(matches(spark, sf_dir), BASE_B)), "avg_points_played")


def union_by_name_columns(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_totalprice").alias("amount"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("custkey"))
    return union_by_name([orders, customers]).select("custkey", "amount", "name")


def csv_union(spark, sf_dir):
    """Orders as CSV files of two column orders, one with a column more, read back as one table by name."""
    folder = scratch_path(spark, "csv")
    note = F.concat(F.lit('say "'), F.col("o_orderpriority"), F.lit('", or\n'), F.col("o_orderstatus"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", note.alias("A.Note"), F.col("o_totalprice").cast("string").alias("price"), "o_orderdate")
    even = F.col("o_orderkey") % 2 == 0
    options = {"header": True, "quote": '"', "escape": '"'}
    orders.where(even).select("o_orderkey", "`A.Note`", "price").write.options(**options).csv(f"{folder}/a")
    orders.where(~even).select("price", "`A.Note`", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderkey").write.options(**options).csv(f"{folder}/b")
    read = read_csvs(spark, f"{folder}/*/*.csv", {"price": "double", "day": "date"})
    return read.select("o_orderkey", F.col("`A.Note`").alias("note"), F.round("price", 2).alias("price"), "day")


def preprocess(spark, sf_dir):
    """Lines as raw rows with an index column, repeated keys, dates of two formats and a percent column."""
    day = F.col("l_shipdate")
    raw = table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("Unnamed: 0"),
        F.col("l_orderkey").alias("EventId"),
        F.col("l_suppkey").alias("at"),
        F.when(F.col("l_orderkey") % 3 == 0, F.lit("soon")).otherwise(F.date_format(day, "yyyy-M-d")).alias("StartDate"),
        F.when(F.col("l_orderkey") % 3 == 1, F.date_format(day, "yyyy-MM-dd'T'10:20:30")).otherwise(F.date_format(day, "yyyy-MM-dd 00:00:00")).alias("EndDate"),
        F.col("l_tax").alias("X.Percent"),
    )
    made = clean.preprocess(raw, order=("at", "StartDate", "EndDate"))
    written = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name) for c, name in (("StartDate", "start"), ("EndDate", "end"))]
    return made.select("EventId", "at", *written)


def cache_round_trip(spark, sf_dir):
    path = scratch_path(spark, "cache")
    write_cache(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key.1"), "c_name", "c_acctbal"), path)
    return read_cache(spark, path).toDF("key_1", "name", "balance")


def _coverage_sql(column: str, alias: str, top_n: int = 25, min_count: int = 50) -> str:
    return f"""{ORACLE_LINES} SELECT {column} AS "{alias}", count(*) AS total, CAST(sum(CAST(both_sets AS INT)) AS BIGINT) AS flag_count,
        round(avg(CAST(both_sets AS INT)), {PLACES}) AS flag_rate FROM g GROUP BY 1 HAVING count(*) >= {min_count}
        ORDER BY avg(CAST(both_sets AS INT)) DESC, 3 DESC, 1 ASC NULLS LAST LIMIT {top_n}"""


_STATS = f"""{ORACLE_LINES}, r AS (SELECT base, sn, x, y, CASE WHEN y > 0 THEN x / y END AS rate FROM c),
s AS (SELECT base AS stat_base, sn AS set_number, round(avg(rate), {PLACES}) AS rate_mean, round(stddev_samp(rate), {PLACES}) AS rate_std,
      CAST(count(CASE WHEN y > 0 AND x IS NOT NULL THEN 1 END) AS BIGINT) AS rate_n, round(avg(y), {PLACES}) AS total_mean,
      round(stddev_samp(y), {PLACES}) AS total_std, CAST(count(y) AS BIGINT) AS total_n FROM r GROUP BY 1, 2)"""
_POINTS = f"""{ORACLE_LINES}, n AS (SELECT unnest(range(1, 7)) AS sn),
p AS (SELECT m.eid AS "EventId", m.ey AS "EventYear", m.mid AS "MatchId", CAST(n.sn AS INTEGER) AS set_number, l.l_quantity AS points_played
      FROM m CROSS JOIN n LEFT JOIN l ON l.eid = m.eid AND l.sn = n.sn AND l.team = 'PlayerTeam1')"""
_FIRST_BY = "SELECT {out} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM lineitem) WHERE rn = 1"
_SWEEP = " UNION ALL ".join(
    f"SELECT '{driver}' AS driver, CAST({column} AS VARCHAR) AS value, both_sets FROM g"
    for driver, column in (("EventYear", "ey"), ("EventType", "etype"), ("Court", "court"))
)

ORACLES = {
    "dedup_first": _FIRST_BY.format(
        out="l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity", keys=", ".join(LINE_KEYS), order=", ".join(LINE_ORDER)
    ),
    "dedup_partial_key": _FIRST_BY.format(
        out="l_suppkey, l_orderkey, l_linenumber, l_partkey", keys="l_suppkey", order=", ".join(("l_orderkey", "l_linenumber", *LINE_ORDER))
    ),
    "drop_columns_by_suffix": "SELECT o_orderkey AS unnamed_1, o_orderstatus AS percent_x, o_orderpriority AS percent_y FROM orders",
    "lenient_numeric_cast": """SELECT event_id AS id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS number FROM events
        UNION ALL SELECT conv_id, TRY_CAST(text AS DOUBLE) FROM conversations""",
    "lenient_date_cast": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders",
    "safe_ratio": f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount > 0 THEN round(l_tax / l_discount, {PLACES}) END AS rate
        FROM lineitem""",
    "presence_flags": f"""{ORACLE_LINES} SELECT eid AS "EventId", s2 AS has_set2_stats, s3 AS has_set3_stats,
        both_sets AS has_set2_and_3_stats FROM g""",
    "flag_totals": f"""{ORACLE_LINES} SELECT count(*) AS n_rows, count(*) FILTER (s2) AS n_has_set2_stats,
        count(*) FILTER (s3) AS n_has_set3_stats, count(*) FILTER (both_sets) AS n_has_set2_and_3_stats,
        round(avg(CAST(both_sets AS INT)), {PLACES}) AS share_with_both FROM g""",
    "coverage_by_priority": _coverage_sql("etype", "EventType"),
    "coverage_by_status": _coverage_sql("court", "Court"),
    "coverage_by_year": _coverage_sql("ey", "EventYear", min_count=1),
    "coverage_min_count": _coverage_sql("ey", "EventYear", min_count=2100),
    "coverage_top_n": _coverage_sql("etype", "EventType", top_n=2, min_count=1),
    "coverage_null_group": _coverage_sql("nullif(court, 'P')", "Court", min_count=1),
    "coverage_sweep": f"""{ORACLE_LINES}, w AS ({_SWEEP}), t AS (SELECT driver, value, count(*) AS total,
        CAST(sum(CAST(both_sets AS INT)) AS BIGINT) AS flag_count, avg(CAST(both_sets AS INT)) AS r FROM w GROUP BY 1, 2),
        k AS (SELECT *, row_number() OVER (PARTITION BY driver ORDER BY r DESC, flag_count DESC, value ASC NULLS LAST) AS n FROM t)
        SELECT driver, value, total, flag_count, round(r, {PLACES}) AS flag_rate, CAST(n AS INTEGER) AS rank FROM k WHERE n <= 30""",
    "wide_to_long": f"""{ORACLE_LINES} SELECT eid AS "EventId", base AS stat_base, sn AS set_number, team,
        CASE WHEN y > 0 THEN round(x / y, {PLACES}) END AS rate, round(y, {PLACES}) AS total, y IS NOT NULL AS has_total,
        coalesce(y > 0 AND x IS NOT NULL, false) AS has_valid_rate
        FROM (SELECT eid, CAST(n AS INTEGER) AS sn, team, base FROM m CROSS JOIN unnest(range(1, 7)) AS r(n)
              CROSS JOIN (VALUES ('PlayerTeam1'), ('PlayerTeam2')) AS t(team) CROSS JOIN (VALUES ('{BASE_A}'), ('{BASE_B}')) AS b(base))
        LEFT JOIN c USING (eid, sn, team, base)""",
    "set_stats": f"{_STATS} SELECT * FROM s WHERE rate_n >= 1 AND total_n >= 1",
    "set_stats_min_zero": f"{_STATS} SELECT * FROM s",
    "set_stats_top30": f"""{_STATS}, t AS (SELECT *, sum(rate_n) OVER (PARTITION BY stat_base) AS z FROM s WHERE rate_n >= 1 AND total_n >= 1)
        SELECT * EXCLUDE (z) FROM t ORDER BY z DESC, stat_base, set_number LIMIT 30""",
    "stat_totals_window": f"""{_STATS} SELECT stat_base, set_number, rate_n,
        CAST(sum(rate_n) OVER (PARTITION BY stat_base) AS BIGINT) AS total_rate_n_for_stat FROM s""",
    "points_per_match_set": f"""{_POINTS} SELECT "EventId", "EventYear", "MatchId", set_number, round(points_played, {PLACES}) AS points_played
        FROM p""",
    "points_per_set": f"""{_POINTS} SELECT set_number, round(avg(points_played), {PLACES}) AS avg_points_played, count(points_played) AS n
        FROM p GROUP BY 1""",
    "points_chart": f"""{_POINTS} SELECT CAST(set_number AS VARCHAR) AS set_label, round(avg(points_played), {PLACES}) AS avg_points_played
        FROM p GROUP BY set_number""",
    "csv_union": """SELECT o_orderkey, 'say "' || o_orderpriority || '", or' || chr(10) || o_orderstatus AS note, round(o_totalprice, 2) AS price,
        CASE WHEN o_orderkey % 2 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders""",
    "preprocess": """SELECT l_orderkey AS "EventId", l_suppkey AS at,
        CASE WHEN l_orderkey % 3 <> 0 THEN strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d 00:00:00') END AS start,
        strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d ') || CASE WHEN l_orderkey % 3 = 1 THEN '10:20:30' ELSE '00:00:00' END AS "end"
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey,
              CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE strftime(CAST(l_shipdate AS DATE), '%Y-%-m-%-d') END, CAST(l_shipdate AS DATE)) AS n FROM lineitem)
        WHERE n = 1""",
    "cache_round_trip": "SELECT c_custkey AS key_1, c_name AS name, c_acctbal AS balance FROM customer",
    "union_by_name_columns": """SELECT o_custkey AS custkey, o_totalprice AS amount, CAST(NULL AS VARCHAR) AS name FROM orders
        UNION ALL SELECT c_custkey, NULL, c_name FROM customer""",
}

QUERIES = {name: globals()[name] for name in ORACLES}
