import pytest

from brindle.operators.clean import dedup_first, drop_index_column
from brindle.sources import column_names, infer_kinds, list_files, print_columns, read_cache, read_csvs, report, rows_frame, write_cache


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.csv").write_text("Unnamed: 0,EventId,P1[0].S.X.Divisor,P1[0].S.X.Dividend\n0,1,10,6\n1,1,10,7\n2,2,NA,\n3,3,0,0\n")
    (tmp_path / "b.csv").write_text("P1[0].S.X.Dividend,EventId,Extra\n4,9,z\n")
    return f"file://{tmp_path}"


SCHEMA = {"EventId": "int", "P1[0].S.X.Divisor": "double", "P1[0].S.X.Dividend": "double"}


def test_files_are_united_by_name(spark, folder):
    df = drop_index_column(read_csvs(spark, f"{folder}/*.csv", SCHEMA))
    rows = df.orderBy("_src_file", "_src_block", "_src_row").collect()
    got = [(r.EventId, r["P1[0].S.X.Dividend"], r["P1[0].S.X.Divisor"], r.Extra) for r in rows]
    assert got == [(1, 6.0, 10.0, None), (1, 7.0, 10.0, None), (2, None, None, None), (3, 0.0, 0.0, None), (9, 4.0, None, "z")]
    assert "Unnamed: 0" not in df.columns


def test_first_row_is_first_in_file_order(spark, folder):
    kept = dedup_first(read_csvs(spark, f"{folder}/*.csv", SCHEMA))
    assert sorted((r.EventId, r["P1[0].S.X.Dividend"]) for r in kept.where("EventId = 1").collect()) == [(1, 6.0)]


def test_listing_is_sorted_and_no_file_raises(spark, folder):
    assert [p.rsplit("/", 1)[1] for p in list_files(spark, f"{folder}/*.csv")] == ["a.csv", "b.csv"]
    with pytest.raises(FileNotFoundError):
        read_csvs(spark, f"{folder}/*.none")


def test_cache_and_console(spark, folder, capsys):
    df = rows_frame(spark, [(1, "x")], "a int, `b.c` string")
    write_cache(df, f"{folder}/cache")
    again = read_cache(spark, f"{folder}/cache")
    assert again.collect() == df.collect() and print_columns(again) == ["a", "b.c"]
    report({"t": again})
    assert "=== t ===" in capsys.readouterr().out


def test_quoted_values(spark, tmp_path):
    (tmp_path / "q.csv").write_text('\ufeffa,b,,a\n"x ""q"", y",2,i,1\n"line1\nline2",3,j,2\n,,k,\n')
    (tmp_path / "r.csv").write_text("b,c\n5,True\n")
    (tmp_path / "empty.csv").write_text("")
    df = read_csvs(spark, f"file://{tmp_path}/*.csv")
    rows = df.orderBy("_src_file", "_src_row").collect()
    assert [(r.a, r.b, r["Unnamed: 2"], r["a.1"], r.c) for r in rows] == [
        ('x "q", y', 2, "i", 1, None),
        ("line1\nline2", 3, "j", 2, None),
        (None, None, "k", None, None),
        (None, 5, None, None, True),
    ]
    assert {f.name: f.dataType.simpleString() for f in df.schema if f.name in ("a", "b", "c")} == {"a": "string", "b": "bigint", "c": "boolean"}
    assert read_csvs(spark, f"file://{tmp_path}/r.csv", infer=False).first().b == "5"
    with pytest.raises(ValueError, match="header"):
        read_csvs(spark, f"file://{tmp_path}/empty.csv")


def test_header_names_and_compressed_files(spark, tmp_path):
    import gzip

    assert column_names('a,"b\nc",,a,a,\n') == ("a", "b\nc", "Unnamed: 2", "a.1", "a.2", "Unnamed: 5")
    with gzip.open(tmp_path / "z.csv.gz", "wt") as out:
        out.write("n\n1.5\n")
    assert read_csvs(spark, f"file://{tmp_path}/z.csv.gz").first().n == 1.5


def test_kinds_are_those_of_all_values(spark):
    rows = [("1", "1", "x", "True", None, "007"), (None, "2.5", "1", "false", None, "8"), ("-3", "1e3", "2", "TRUE", None, " 9")]
    df = rows_frame(spark, rows, "i string, d string, s string, b string, n string, z string")
    assert infer_kinds(df, df.columns) == {"i": "long", "d": "double", "b": "boolean", "z": "long"}
    assert infer_kinds(df, []) == {}
