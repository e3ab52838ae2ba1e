import math

import pytest
from pyspark.sql import functions as F

from brindle.functions import null_if_nan, safe_div, to_date, to_numeric
from brindle.operators import clean, coverage, setstats
from brindle.operators.cells import DEFAULT_BASE, Catalogue

NAN = float("nan")
BOTH = coverage.FLAGS[2]


def wide(spark, columns):
    """A frame from {name: (type, values)}."""
    schema = ", ".join(f"`{n}` {t}" for n, (t, _) in columns.items())
    return spark.createDataFrame(list(zip(*(v for _, v in columns.values()), strict=True)), schema)


def col(team, i, base=DEFAULT_BASE, part="Divisor"):
    return f"PlayerTeam{team}.Sets[{i}].{base}.{part}"


def flags(df):
    rows = coverage.add_set_flags(df).select(*coverage.FLAGS).collect()
    return [list(x) for x in zip(*rows, strict=True)]


def test_flags_without_columns(spark):
    assert flags(wide(spark, {"EventYear": ("int", [2024, 2025])})) == [[False, False]] * 3


def test_flags_from_one_team(spark):
    df = wide(spark, {col(1, 1): ("double", [10.0, None, 5.0])}).coalesce(1)
    assert flags(df) == [[True, False, True], [False] * 3, [False] * 3]


def test_flags_from_both_teams(spark):
    for third, both in (([2.0, None, 9.0], [False] * 3), ([2.0, 4.0, 9.0], [False, True, False])):
        df = wide(spark, {col(2, 1): ("double", [None, 7.0, NAN]), col(1, 2): ("double", third)}).coalesce(1)
        assert flags(df) == [[False, True, False], [x is not None for x in third], both]


def test_coverage_without_the_column(spark):
    assert coverage.coverage_by(wide(spark, {BOTH: ("boolean", [True, False, True])}), "TournamentName") is None


def test_coverage_counts_and_order(spark):
    df = wide(spark, {"EventYear": ("int", [2025] * 4 + [2026] * 4), BOTH: ("boolean", [True, True, False, False, True, False, False, False])})
    got = [tuple(r) for r in coverage.coverage_by(df, "EventYear", top_n=10, min_count=1).collect()]
    assert got == [(2025, 4, 2, 0.5), (2026, 4, 1, 0.25)]


def test_coverage_ties_missing_keys_and_limits(spark):
    df = wide(spark, {"k.x": ("string", ["b", "a", None, "c", "c"]), BOTH: ("boolean", [True, True, True, False, True])})
    run = lambda **k: [tuple(r) for r in coverage.coverage_by(df, "k.x", **k).collect()]
    assert run(min_count=1) == [("a", 1, 1, 1.0), ("b", 1, 1, 1.0), (None, 1, 1, 1.0), ("c", 2, 1, 0.5)]
    assert run(min_count=2) == [("c", 2, 1, 0.5)]
    assert [r[0] for r in run(min_count=1, top_n=2)] == ["a", "b"]
    sweep = coverage.coverage_sweep(df, ["k.x", "none"], min_count=1).orderBy("rank").collect()
    assert [(r.driver, r.value, r.total) for r in sweep] == [("k.x", "a", 1), ("k.x", "b", 1), ("k.x", None, 1), ("k.x", "c", 2)]
    assert coverage.coverage_sweep(df, ["none"]).collect() == []
    assert list(coverage.coverage_tables(df, ["k.x", "none"], min_count=1)) == ["k.x"]
    assert coverage.coverage_tables(df, ["k.x"], min_count=50) == {}


def test_set_stats_of_one_base(spark):
    df = wide(
        spark,
        {
            col(1, 0, part="Dividend"): ("double", [6.0, 8.0]),
            col(1, 0): ("double", [10.0, 8.0]),
            col(2, 0, part="Dividend"): ("double", [5.0, 4.0]),
            col(2, 0): ("double", [10.0, 8.0]),
        },
    )
    (row,) = setstats.set_stats(df).collect()
    assert (row.stat_base, row.set_number, row.rate_n, row.total_n) == (DEFAULT_BASE, 1, 4, 4)
    assert math.isclose(row.rate_mean, 0.65, abs_tol=1e-12) and math.isclose(row.total_mean, 9.0, abs_tol=1e-12)
    assert setstats.set_stats(df, min_rate_n=10).collect() == []
    none = setstats.set_stats(wide(spark, {"a": ("int", [1])}))
    assert none.schema == setstats.SET_STATS and none.collect() == []
    assert setstats.cell(df, "PlayerTeam1", 1, DEFAULT_BASE) is None
    assert setstats.cell(df, "PlayerTeam1", 0, DEFAULT_BASE).columns == ["set_number", "team", "rate", "total", "has_total", "has_valid_rate"]


@pytest.mark.parametrize("missing", [None, NAN])
def test_ratio_edges(spark, missing):
    m = missing
    df = wide(
        spark,
        {
            col(1, 0, "B", "Dividend"): ("double", [1.0, 2.0, 3.0, m, 5.0]),
            col(1, 0, "B"): ("double", [2.0, 0.0, -4.0, 8.0, m]),
            col(2, 0, "B", "Dividend"): ("double", [3.0, m, m, m, m]),
            col(2, 0, "B"): ("double", [4.0, m, m, m, m]),
        },
    )
    (r,) = setstats.set_stats(df).collect()
    assert (r.rate_n, r.total_n) == (2, 5)
    assert [round(x, 10) for x in (r.rate_mean, r.rate_std, r.total_mean, r.total_std)] == [0.625, 0.1767766953, 2.0, 4.4721359550]


def test_discovery_order_and_filters(spark):
    n = None
    cells = {
        (0, "A"): ([1.0, 1.0, n], [2.0, 2.0, n]),
        (1, "A"): ([1.0, n, n], [4.0, n, n]),
        (0, "B"): ([1.0, 1.0, 1.0], [2.0, 4.0, 4.0]),
        (6, "D"): ([1.0, 1.0, 1.0], [2.0, 4.0, 4.0]),
    }
    columns = {col(1, 0, "C", "Dividend"): ("double", [1.0] * 3)}
    for (i, base), (x, y) in cells.items():
        columns |= {col(1, i, base, "Dividend"): ("double", x), col(1, i, base): ("double", y)}
    df = wide(spark, columns)
    assert Catalogue.of(df).bases == ("A", "B", "C", "D")
    show = lambda rows: [(r.stat_base, r.set_number, round(r.rate_mean, 10), r.rate_std and round(r.rate_std, 10), r.rate_n, r.total_n) for r in rows]
    assert show(setstats.set_stats(df).collect()) == [
        ("A", 1, 0.5, 0.0, 2, 2),
        ("A", 2, 0.25, None, 1, 1),
        ("B", 1, 0.3333333333, 0.1443375673, 3, 3),
    ]
    assert [(r.stat_base, r.set_number) for r in setstats.set_stats(df, min_rate_n=2).collect()] == [("B", 1), ("A", 1)]


def test_min_zero_keeps_groups_without_rates(spark):
    df = wide(spark, {col(1, 0, "A", "Dividend"): ("double", [None]), col(1, 0, "A"): ("double", [None])})
    (row,) = setstats.set_stats(df, min_rate_n=0, min_total_n=0).collect()
    assert (row.rate_mean, row.rate_n, row.total_n) == (None, 0, 0)
    assert setstats.set_stats(df).collect() == []


def test_points_per_match_and_set(spark):
    df = wide(
        spark,
        {
            "EventId": ("int", [1, 1, 2, None]),
            "EventYear": ("int", [2025] * 4),
            "MatchId": ("string", ["m1", "m1", "m2", "m3"]),
            col(1, 0): ("double", [100.0, 20.0, None, 60.0]),
            col(1, 1): ("double", [50.0, None, None, None]),
            col(2, 0): ("double", [9.0] * 4),
        },
    )
    points = {(r.MatchId, r.set_number): r.points_played for r in setstats.match_points(df).collect()}
    assert points == {("m1", 1): 120.0, ("m2", 1): None, ("m3", 1): 60.0, ("m1", 2): 50.0, ("m2", 2): None, ("m3", 2): None}
    summary = setstats.points_per_set(df)
    assert [tuple(r) for r in summary.collect()] == [(1, 90.0, 2), (2, 50.0, 1)]
    assert [r.set_label for r in setstats.points_chart(summary).collect()] == ["1", "2"]
    with pytest.raises(ValueError, match="denominator"):
        setstats.match_points(df, "No.Such")
    assert setstats.set_total(df, "PlayerTeam1", 5, DEFAULT_BASE, ["EventId"]) is None
    total = setstats.set_total(df, "PlayerTeam1", 1, DEFAULT_BASE, ["MatchId", "EventId"])
    assert total.columns == ["set_number", "total", "MatchId", "EventId"]
    assert sorted(map(tuple, total.collect()), key=repr) == sorted([(2, 50.0, "m1", 1), (2, None, "m1", 1), (2, None, "m2", 2), (2, None, "m3", None)], key=repr)


def test_lenient_numbers(spark):
    good = {" 1 ": 1.0, "1e3": 1000.0, "-5": -5.0, ".5": 0.5, "inf": math.inf}
    bad = ["1d", "1f", "", "abc", "1,000", "0x10", "1_000", "True", "NA", "nan", None]
    df = spark.createDataFrame([(x,) for x in [*good, *bad]], "x string").select("x", to_numeric(F.col("x")).alias("n"))
    assert {r.x: r.n for r in df.collect()} == good | dict.fromkeys(bad)


def test_lenient_dates(spark):
    texts = ["2024-01-05", "2024-1-5", "2024-13-01", "2024", "x", "01/05/2024", None]
    df = spark.createDataFrame([(x,) for x in texts], "x string").select(to_date(F.col("x")).alias("d"))
    assert [r.d and str(r.d) for r in df.coalesce(1).collect()] == ["2024-01-05", "2024-01-05", None, None, None, None, None]


def test_safe_div(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (1.0, -1.0), (None, 2.0), (1.0, None), (1.0, NAN)], "a double, b double")
    got = df.coalesce(1).select(safe_div(F.col("a"), null_if_nan(F.col("b"))).alias("r")).collect()
    assert [r.r for r in got] == [0.5, None, None, None, None, None]


def test_first_row_dedup(spark):
    rows = [(1, 2025, "a", 0), (1, 2025, "b", 1), (None, 2025, "c", 2), (None, 2025, "d", 3), (2, 2025, "e", 4)]
    df = spark.createDataFrame(rows, "EventId int, EventYear int, v string, at int").repartition(3)
    run = lambda d, **k: sorted(r.v for r in clean.dedup_first(d, order=["at"], **k).collect())
    assert run(df) == ["a", "c", "e"]
    assert run(df.drop("EventId")) == ["a"]
    assert run(df.drop("EventId", "EventYear")) == ["a", "b", "c", "d", "e"]


def test_preprocess_drops_by_exact_name_and_suffix(spark):
    names = ["Unnamed: 0", "Unnamed: 1", "X.Percent", "PercentX", "X.Percent.Y", "StartDate"]
    df = wide(spark, {n: ("string", ["2024-1-5"]) for n in names})
    out = clean.preprocess(df)
    assert out.columns == ["Unnamed: 1", "PercentX", "X.Percent.Y", "StartDate"] and df.columns == names
    assert str(out.first().StartDate) == "2024-01-05 00:00:00"


def test_each_date_column_has_its_format(spark):
    texts = ["2024-01-07 00:00:00", "2024-01-08T10:00:00", "2024-1-9", "2024-01-10 09:30", "2024-01-11 01:02:03.250", "2024", "x", None]
    df = spark.createDataFrame([(x, x) for x in texts], "EndDate string, StartDate string").coalesce(1)
    rows = clean.coerce_dates(df).collect()
    want = ["2024-01-07 00:00:00", "2024-01-08 10:00:00", "2024-01-09 00:00:00", "2024-01-10 09:30:00", "2024-01-11 01:02:03.250000"]
    assert [r.EndDate and str(r.EndDate) for r in rows] == [*want, None, None, None]
    assert [r.StartDate and str(r.StartDate) for r in rows] == [None, None, "2024-01-09 00:00:00", *[None] * 5]
    assert clean.coerce_dates(df, {"StartDate": "yyyy"}).collect()[5].StartDate.year == 2024


def test_nan_and_null_are_one_key(spark):
    df = spark.createDataFrame([(NAN, True, 1, 5.0), (None, False, 2, 6.0), (1.0, True, 3, 7.0)], f"k double, {BOTH} boolean, at int, `{col(1, 0)}` double")
    assert {tuple(r) for r in coverage.coverage_by(df, "k", min_count=1).collect()} == {(None, 2, 1, 0.5), (1.0, 1, 1, 1.0)}
    assert {(r.value, r.total) for r in coverage.coverage_sweep(df, ["k"], min_count=1).collect()} == {(None, 2), ("1.0", 1)}
    assert sorted(r.at for r in clean.dedup_first(df, ["k"], ["at"]).collect()) == [1, 3]
    assert {(r.k, r.points_played) for r in setstats.match_points(df, keys=["k"]).collect()} == {(None, 11.0), (1.0, 7.0)}
